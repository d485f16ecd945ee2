"""Passages of held-out evaluation items inside a training corpus: finding them, removing spans or documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Words of a passage.
PASSAGE = 13
#: Bytes that the passages of all items may take in a worker's memory to be broadcast; beyond it they are joined.
MAX_BROADCAST = 512 << 20
#: Bytes of a passage in a worker besides its words: its entries in a dictionary, its tuple, its hash.
PASSAGE_BYTES = 400
#: Bits of the map of the passages' hashes that then keeps other windows from being shuffled: 16 for each passage, within these.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30

_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words_of(text: str | None) -> list[str]:
    """Runs of Unicode letters and digits in lower case; a text that lowering lengthens (a dotted I becomes two signs) is cut before it is lowered."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def window_hashes(words: list[str], length: int) -> np.ndarray:
    """A hash of every run of `length` successive words, whatever stands before it."""
    n = len(words)
    if n < length or not length:
        return np.zeros(0, dtype=np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    return _windows(h, _powers(_STEP, n), _powers(_BACK, n), length)


def _windows(h: np.ndarray, up: np.ndarray, down: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return (sums[length:] - sums[:-length]) * down[: len(h) - length + 1] + np.uint64(length)


def passages(items: DataFrame, *, item: str = "item_id", text: str = "text", size: int = PASSAGE) -> DataFrame:
    """(item, n, hash, words): each distinct passage of `size` successive words of each item; all words of a shorter item. Wordless items have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item"], b["text"], strict=True):
                w = words_of(t)
                n = min(size, len(w))
                for k, h in enumerate(window_hashes(w, n)):
                    rows.append((i, n, np.int64(h.astype(np.int64)), " ".join(w[k : k + n])))
            yield pd.DataFrame(rows, columns=["item", "n", "hash", "words"])

    return items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).mapInPandas(cut, "item bigint, n int, hash bigint, words string").distinct()


def _scan(batches: Iterator[pd.DataFrame], lengths: list[int], wanted: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Every window of each length whose hash is wanted: (doc, n, hash, start, words)."""
    for b in (whole.iloc[k : k + 500] for whole in batches for k in range(0, len(whole), 500)):
        texts = [words_of(t) for t in b["text"]]
        flat = np.array([w for t in texts for w in t], dtype=object)
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(counts)
        out: dict[str, list] = {"doc": [], "n": [], "hash": [], "start": [], "words": []}
        if len(flat):
            h = pd.util.hash_array(flat, categorize=True)
            up, down = _powers(_STEP, len(h)), _powers(_BACK, len(h))
            of = np.repeat(np.arange(len(texts)), counts)
            for n in lengths:
                if len(h) < n:
                    continue
                w = _windows(h, up, down, n)
                whole = of[: len(w)] == of[n - 1 :]  # the window doesn't leave its document
                hit = whole & wanted(n, w)
                for k in np.flatnonzero(hit):
                    d = int(of[k])
                    s = int(k - (ends[d] - counts[d]))
                    out["doc"].append(b["doc"].iloc[d])
                    out["n"].append(n)
                    out["hash"].append(np.int64(w[k].astype(np.int64)))
                    out["start"].append(s)
                    out["words"].append(" ".join(flat[k : k + n]))
        if out["doc"]:  # a column without values would have no type
            yield pd.DataFrame(out)


_HITS = "doc bigint, n int, hash bigint, start int, words string"


def hash_bits(grams: DataFrame, bits: int) -> np.ndarray:
    """A map of `bits` bits (a power of two), of which those are set that hashes of the passages have as their upper bits.

    The bits are put together by Spark, 64 to a row, so that the driver gets at most bits / 64 rows.
    """
    place = F.shiftrightunsigned(F.col("hash"), 64 - bits.bit_length() + 1)
    marked = grams.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    words = marked.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).toPandas()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be those of passages."""
    place = hashes >> np.uint64(64 - len(marks).bit_length() + 1 - 6)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def find_leaks(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = PASSAGE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc, item, start, n): each place, counted in words, where a document holds a passage of an item.

    A passage is `size` successive words, or all words of a shorter item; words are runs of letters and digits in lower case,
    whatever stands between them. The passages are broadcast with their hash set if their bytes, which are counted first, are
    within `max_broadcast`. Otherwise a map of bits of a fixed size is broadcast, which holds all their hashes and few others,
    and the documents' windows that it lets through are joined with them. Either way every hit is verified by its words.
    Null, empty and wordless texts hold nothing; equal rows give equal results once; other columns are ignored.
    """
    grams = passages(items, item=item, text=item_text, size=size).persist()
    rows = spread(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null"))
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # at most `size` values
    total = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(2 * F.octet_length("words")), F.lit(0)).alias("size")).first()
    context = docs.sparkSession.sparkContext
    if total.n * PASSAGE_BYTES + total.size <= max_broadcast:
        by_hash = defaultdict(list)
        by_length = defaultdict(set)
        for r in grams.toLocalIterator():
            by_hash[r.n, r.hash].append((r.item, r.words))
            by_length[r.n].add(np.uint64(r.hash % 2**64))
        wanted = {k: np.array(sorted(v), dtype=np.uint64) for k, v in by_length.items()}
        shared = context.broadcast((dict(by_hash), wanted))
        grams.unpersist()

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of, sets = shared.value
            for hits in _scan(batches, lengths, lambda n, w: np.isin(w, sets[n])):
                found = [(d, i, s, k) for d, k, h, s, w in hits.itertuples(index=False) for i, x in of[k, h] if x == w]
                yield pd.DataFrame(found, columns=["doc", "item", "start", "n"])

        leaks = rows.mapInPandas(scan, "doc bigint, item bigint, start int, n int")
    else:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * total.n).bit_length()))
        marks = context.broadcast(hash_bits(grams, bits))
        windows = rows.mapInPandas(lambda b: _scan(b, lengths, lambda _, w: _marked(marks.value, w)), _HITS)
        leaks = windows.join(grams, ["n", "hash", "words"]).select("doc", "item", "start", "n")
    return leaks.distinct().select(F.col("doc").alias(doc), F.col("item").alias(item), "start", "n")


def leaked_pairs(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", **how) -> DataFrame:  # noqa: ANN003
    """(doc, item): each document with each item that leaked into it, once."""
    return find_leaks(docs, items, doc=doc, item=item, **how).select(doc, item).distinct()


def drop_leaked(docs: DataFrame, leaks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """The documents into which nothing leaked, with all their columns."""
    return docs.join(leaks.select(doc).distinct(), doc, "left_anti")


def cut_leaked(docs: DataFrame, leaks: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text): every document, without the words of leaked passages and what stands between them; `doc` must be unique."""
    spans = leaks.groupBy(doc).agg(F.collect_set(F.struct("start", "n")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, spans_ in zip(b["text"], b["spans"], strict=True):
                if spans_ is None or t is None:
                    out.append(t)
                    continue
                low = t.lower()
                # places are those of the lower-cased text; where lowering changes a text's length, the original is aligned word by word
                at = [m.span() for m in (_WORD.finditer(t) if len(low) != len(t) else _WORD.finditer(low))]
                keep, last = [], 0
                for s, e in sorted((x["start"], x["start"] + x["n"]) for x in spans_):
                    a, z = at[min(s, len(at) - 1)][0], at[min(e, len(at)) - 1][1]
                    if z > last:
                        keep.append(t[last : max(a, last)])
                        last = z
                out.append("".join(keep) + t[last:])
            yield pd.DataFrame({"doc": b["doc"], "text": out})

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).join(spans.select(F.col(doc).alias("doc"), "spans"), "doc", "left")
    done = rows.mapInPandas(cut, "doc bigint, text string")
    return done.select(F.col("doc").alias(doc), F.col("text").alias(text))
