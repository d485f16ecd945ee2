"""Encoding of a whole corpus with a public byte-level BPE vocabulary, each distinct word once; and decoding.

The corpus is cut into blocks of whole documents. A block's pre-tokens become one row per distinct word with the positions
where it stands, so a word that makes up a twentieth of the corpus is one row a block, not one a use. All distinct words are
encoded once, their ids joined back, and each block reassembled by position. A block is bounded by its number of pre-tokens
(a longer document is a block of its own), so no group grows with the corpus. The words of the most blocks, a fixed number, whose
places are the bulk of the bytes, get their ids by broadcast; only the other words are shuffled to meet theirs.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, spread

#: Pre-tokens of a block, beyond which a new one begins.
BLOCK_TOKENS = 500_000
#: Words of the most blocks whose ids are broadcast, and bytes of such a word with its ids at most: 1.3 MB together at the very most.
FREQUENT_WORDS, FREQUENT_BYTES = 4_096, 320
#: Bytes of a vocabulary file, at most: it is broadcast, as executors may not have it.
VOCABULARY_BYTES = 64 << 20

_ENCODERS: dict = {}


def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file of lines `base64 id`."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def read_vocabulary(path: str) -> bytes:
    """The file's bytes, read on the driver; a file of more than VOCABULARY_BYTES fails."""
    if Path(path).stat().st_size > VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    return Path(path).read_bytes()


def encoder(vocabulary: bytes, pattern: str):  # noqa: ANN201
    """The encoder of a vocabulary, made once in each worker process."""
    key = hashlib.sha256(vocabulary).digest(), pattern
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={})
    return _ENCODERS[key]


_BLOCK = "block bigint, word string, places binary, docs array<bigint>, sizes array<int>"


def _pack_places(order: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The places of each word, order[start:end], as gaps of 1, 2 or 4 bytes, behind a byte that tells which."""
    if not len(order):
        return []
    gaps = np.diff(order, prepend=np.int32(0))
    gaps[starts] = order[starts]
    most = np.maximum.reduceat(gaps, starts)
    widths = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).tolist()
    as_bytes = {w: gaps.astype(f"<u{w}").tobytes() for w in set(widths)}
    return [bytes((w,)) + as_bytes[w][a * w : b * w] for w, a, b in zip(widths, starts.tolist(), ends.tolist(), strict=True)]


def _unpack_places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1), dtype=np.int64)


def _blocks(pattern: str, limit: int):  # noqa: ANN202
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import regex

        find = regex.compile(pattern).findall
        types = pa.schema([("block", pa.int64()), ("word", pa.string()), ("places", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
        docs: list[int] = []
        sizes: list[int] = []

        def fresh() -> tuple[defaultdict[str, int], array]:
            words: defaultdict[str, int] = defaultdict()
            words.default_factory = words.__len__  # a new word gets the next number
            return words, array("i")

        words, codes = fresh()

        def flush() -> pa.RecordBatch:
            of = np.frombuffer(codes, dtype=np.int32) if codes else np.zeros(0, dtype=np.int32)
            order = np.argsort(of, kind="stable").astype(np.int32)
            ends = np.cumsum(np.bincount(of, minlength=len(words))) if len(of) else np.zeros(0, dtype=np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            places = _pack_places(order, starts, ends)
            block = uuid.uuid4().int >> 65
            n = len(words)
            columns = [
                pa.array(np.full(n + 1, block, dtype=np.int64)),
                pa.array([None, *words], pa.string()),
                pa.array([None, *places], pa.binary()),
                pa.array([docs] + [None] * n, pa.list_(pa.int64())),
                pa.array([sizes] + [None] * n, pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=types)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find(text) if text else []
                codes.extend(map(words.__getitem__, found))
                docs.append(doc)
                sizes.append(len(found))
                if len(codes) >= limit or len(docs) >= limit:
                    yield flush()
                    docs, sizes = [], []
                    words, codes = fresh()
        if docs:
            yield flush()

    return cut


def _encode_words(vocabulary: Broadcast, pattern: str):  # noqa: ANN202
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value, pattern)
        for batch in batches:
            words = batch.column(0).to_pylist()
            ids = pa.array([np.array(e.encode_ordinary(w), dtype="<i4").tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["word", "blocks", "ids"])

    return encode


def _assemble(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    head = table.filter(pa.compute.is_valid(table["docs"])).combine_chunks()
    body = table.filter(pa.compute.is_null(table["docs"]))
    docs, sizes = head["docs"][0].values, np.asarray(head["sizes"][0].values, dtype=np.int64)
    n = int(sizes.sum())
    if n:
        word_at = np.empty(n, dtype=np.int64)
        for i, p in enumerate(body["places"].to_pylist()):
            word_at[_unpack_places(p)] = i
        ids = body["ids"].to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        flat = np.frombuffer(b"".join(ids), dtype="<i4")
        length = np.diff(offsets)[word_at]
        ends = np.cumsum(length)
        out = flat[np.repeat(offsets[word_at] - (ends - length), length) + np.arange(int(ends[-1]))]
        ends = np.concatenate([[0], ends])
    else:
        out, ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(out, pa.int32())).cast(pa.list_(pa.int32()))
    return pa.table({"doc": docs, "ids": lists})


def encode_corpus(docs: DataFrame, *, vocabulary: str, pattern: str, doc: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """(doc, ids): the token ids of each row's text, one row for each row of docs.

    Empty and null texts have an empty list. White space counts as any other text. Rows with equal ids or texts stay apart;
    an id may be null; other columns are ignored; an empty table gives an empty result. `frequent` changes the cost only.
    """
    rows = spread(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")))
    blocks = materialize(rows.mapInArrow(_blocks(pattern, block_tokens), _BLOCK), "blocks")
    heads, body = blocks.where("word is null"), blocks.where("word is not null")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    words = body.groupBy("word").agg(F.count("*").alias("blocks"))
    coded = materialize(words.mapInArrow(_encode_words(shared, pattern), "word string, blocks bigint, ids binary"), "coded")
    most = coded.where(F.octet_length("word") + F.octet_length("ids") <= FREQUENT_BYTES).orderBy(F.col("blocks").desc(), "word").limit(frequent).select("word", "ids")
    most = materialize(most, "frequent")
    near = body.join(F.broadcast(most), "word")
    far = body.join(F.broadcast(most.select("word")), "word", "left_anti").join(coded.select("word", "ids"), "word")
    joined = near.unionByName(far).unionByName(heads, allowMissingColumns=True).select("block", "places", "docs", "sizes", "ids")
    return joined.groupBy("block").applyInArrow(_assemble, "doc bigint, ids array<int>").select(F.col("doc").alias(doc), "ids")


def decode_corpus(ids: DataFrame, *, vocabulary: str, doc: str = "doc_id") -> DataFrame:
    """(doc, text): the texts of lists of ids, by a join of the positions with the token-byte table.

    The table has as many rows as the vocabulary (about 50,000, fixed), so it is broadcast. A null list gives a null text, an
    empty one an empty text, an id that the vocabulary lacks fails the query. `doc` must be unique.
    """
    spark = ids.sparkSession
    ranks = load_ranks(read_vocabulary(vocabulary))
    table = spark.createDataFrame(pd.DataFrame({"token": list(ranks.values()), "bytes": list(ranks.keys())}), "token int, bytes binary")
    rows = ids.select(F.col(doc).alias("doc"), F.col("ids").isNull().alias("none"), F.posexplode_outer("ids").alias("pos", "token"))
    tokens = rows.join(F.broadcast(table), "token", "left")
    unknown = F.col("token").isNotNull() & F.col("bytes").isNull()
    part = F.when(unknown, F.raise_error(F.lit("an id that the vocabulary lacks"))).when(F.col("token").isNotNull(), F.struct("pos", F.hex("bytes").alias("hex")))
    texts = tokens.groupBy("doc").agg(F.first("none").alias("none"), F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "UTF-8")
    return texts.select(F.col("doc").alias(doc), F.when(~F.col("none"), joined).alias("text"))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return str(Path(folder) / name)


#: Fixed value: the pre-token pattern that the vocabulary byte_bpe_50k was made with.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
