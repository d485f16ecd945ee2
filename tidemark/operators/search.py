"""Lexical, dense and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fulltext import parsed, stems
from tidemark.functions.text import tokens
from tidemark.session import materialize

#: Bytes of the packed query vectors up to which they are broadcast; beyond it each block of vectors goes to each group of queries.
MAX_QUERY_BYTES = 64 << 20


def top_k(rows: DataFrame, *, query: str, doc: str, score: str, k: int) -> DataFrame:
    """The k best documents of each query with their place; equal scores (to nine places) go by document."""
    w = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), doc)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def document_frequency(docs: DataFrame, *, doc: str, text: str) -> DataFrame:
    """(term, df): the number of documents that hold each term."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, *, doc: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, doc, bm25) of all documents that share a term with a query.

    Repeated query terms count as often as they stand. Documents are cut into tokens once: only terms of the queries leave the
    scan, counted per document before they are shuffled, and one row without a term for each document, from which the number of
    documents and their mean length come. That is written, and all statistics are taken from it.
    """
    wanted = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("tokens"))
    uses = rows.select("doc", F.size("tokens").alias("size"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "tokens")).alias("term"))
    asked = wanted.select("term").distinct().withColumn("asked", F.lit(True))
    counted = uses.join(asked, "term", "left").where("asked or term is null").groupBy("doc", "size", "term").agg(F.count("*").alias("tf"))
    counted = materialize(counted, "terms")
    stats = counted.where("term is null").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    tf = counted.where("term is not null")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / F.greatest(F.lit(1.0), F.col("mean"))))
    weighed = wanted.join(df, "term").join(F.broadcast(stats))
    return tf.join(weighed, "term").groupBy("query", "doc").agg(F.sum(part).alias("bm25"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 against a vector of zeros or of another length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _pack(block: int):  # noqa: ANN202
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                part = batch.slice(k, block)
                m = np.array(part.column(1).to_pylist(), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.astype("<f8").tobytes()])], names=["ids", "matrix"])

    return pack


def _block_pairs(vectors: DataFrame, queries: DataFrame, id: str, vector: str, block: int, max_bytes: int = MAX_QUERY_BYTES) -> DataFrame:  # noqa: A002
    """Each block of vectors with each block of queries.

    The queries' bytes are counted first. Up to `max_bytes` they are broadcast; beyond it they are split into groups of about
    a block, and the blocks of vectors are repeated for each group and shuffled to it.
    """
    packed = "ids array<bigint>, matrix binary"
    rows = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).where("v is not null")
    asked, blocks = rows(queries), rows(vectors).mapInArrow(_pack(block), packed)
    name = lambda df: df.withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
    total = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.size("v") + 8), F.lit(0)).alias("size")).first()
    if total.size <= max_bytes:
        return blocks.join(F.broadcast(name(asked.mapInArrow(_pack(block), packed))))
    groups = -(-total.n // block)

    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_pack(table.num_rows)(iter(table.select(["id", "v"]).combine_chunks().to_batches())))

    asked = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    asked = asked.groupBy("group").applyInArrow(lambda key, table: pack(table).append_column("group", pa.array([key[0].as_py()], pa.int64())), packed + ", group bigint")
    everywhere = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return everywhere.join(name(asked), "group").drop("group")


def _product(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q_ids, ids = np.array(r["q_ids"]), np.array(r["ids"])
    q, m = (np.frombuffer(r[c], dtype="<f8").reshape(len(n), -1) for c, n in (("q_matrix", q_ids), ("matrix", ids)))
    return q_ids, ids, q @ m.T


def similarities(vectors: DataFrame, queries: DataFrame, *, id: str, vector: str, block: int = 1024, max_bytes: int = MAX_QUERY_BYTES) -> DataFrame:  # noqa: A002
    """(query, id, similarity): the cosine of every query with every vector, also with its own. All vectors must have one length."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids, s = _product(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, len(ids))), pa.array(np.tile(ids, len(q_ids))), pa.array(s.ravel())], names=["query", "id", "similarity"])

    return _block_pairs(vectors, queries, id, vector, block, max_bytes).mapInArrow(multiply, "query bigint, id bigint, similarity double")


def nearest(vectors: DataFrame, queries: DataFrame, *, id: str, vector: str, k: int, block: int = 1024, max_bytes: int = MAX_QUERY_BYTES) -> DataFrame:  # noqa: A002
    """(query, id, similarity, place): the k most similar vectors of each query, exactly, by cosine.

    Queries and vectors are packed into blocks; each pair of blocks is one matrix product that keeps k rows a query, and the
    blocks' winners meet in a window by query. A query doesn't find itself. All vectors must have one length.
    """
    pairs = _block_pairs(vectors, queries, id, vector, block, max_bytes)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, ids, s = _product(r)
                s[q_ids[:, None] == ids[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :k]
                qi = np.repeat(q_ids, best.shape[1])
                score = np.take_along_axis(s, best, axis=1).ravel()
                keep = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(qi[keep]), pa.array(ids[best.ravel()][keep]), pa.array(score[keep])], names=["query", "id", "similarity"])

    found = pairs.mapInArrow(multiply, "query bigint, id bigint, similarity double")
    return top_k(found, query="query", doc="id", score="similarity", k=k)


def hybrid(lexical: DataFrame, dense: DataFrame, *, k: int = 50) -> DataFrame:
    """(query, doc, hybrid, place): 0.45 of the lexical score against the query's best, 0.55 of the cosine moved to [0, 1]; the k best.

    dense: (query, doc, cosine) of all documents searched; documents that no term finds have a lexical score of 0.
    """
    best = lexical.groupBy("query").agg(F.max("bm25").alias("best"))
    both = dense.join(lexical, ["query", "doc"], "left").join(F.broadcast(best), "query", "left")
    share = F.coalesce("bm25", F.lit(0.0)) / F.greatest(F.lit(1e-6), F.coalesce("best", F.lit(0.0)))
    rows = both.select("query", "doc", (0.45 * share + 0.55 * (F.col("cosine") + 1.0) / 2.0).alias("hybrid"))
    return top_k(rows, query="query", doc="doc", score="hybrid", k=k)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x))))


def blend(candidates: DataFrame, *, learned: Column, cross: Column, reranked: int = 20) -> DataFrame:
    """Add `final`: a quarter hybrid, a quarter learned, half cross; the first `reranked` places have the cross score, the rest the learned one again."""
    second = F.when(F.col("place") <= reranked, cross).otherwise(learned)
    return candidates.withColumn("final", 0.25 * F.col("hybrid") + 0.25 * learned + 0.5 * sigmoid(second))


def _holds(words: Column, wanted: list[str]) -> Column:
    """Whether an array of stems holds some in succession."""
    if len(wanted) == 1:
        return F.array_contains(words, wanted[0])
    return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words))), lambda i: F.slice(words, i, len(wanted)) == F.array(*map(F.lit, wanted)))


def full_text(repositories: DataFrame, query: str, *, scores: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(full_name, rank): repositories that a search in the syntax of web search engines finds, by their words' stems.

    Archived ones are left out. Each term of the search counts 1 if the name holds it, and 0.4 if description or topics do;
    0.45 of a leaderboard score (full_name, score) is added to 0.55 of that. A search without terms finds nothing.
    """
    rows = repositories.where(~F.col("is_archived")).select(
        "full_name", "stars", stems("translate(full_name, '/_-', '   ')").alias("a"), stems("concat_ws(' ', description, array_join(topics, ' '))").alias("b")
    )
    rows = materialize(rows, "stems")  # stems are taken once, whatever the search asks
    options = parsed(query)
    terms = list({t: None for option in options for t in option})
    if not terms:
        return rows.limit(0).select("full_name", F.lit(0.0).alias("rank"))
    asked = repositories.sparkSession.createDataFrame([(i, t.words) for i, t in enumerate(terms)], "n int, words string")
    asked = {r.n: r.stems for r in asked.select("n", stems("words").alias("stems")).collect()}  # the search's own words
    holds = lambda side, term: _holds(F.col(side), asked[terms.index(term)])
    match, rank = F.lit(False), F.lit(0.0)
    for option in options:
        hit = F.lit(True)
        for term in option:
            there = holds("a", term) | holds("b", term)
            hit = hit & (~there if term.excluded else there)
        match = match | hit
    for term in (t for t in terms if not t.excluded):
        rank = rank + F.when(holds("a", term), 1.0).otherwise(0.0) + F.when(holds("b", term), 0.4).otherwise(0.0)
    found = rows.where(match).withColumn("rank", 0.55 * rank)
    if scores is not None:
        found = found.join(scores, "full_name", "left").withColumn("rank", F.col("rank") + 0.45 * F.coalesce("score", F.lit(0.0)))
    return found.orderBy(F.round("rank", 9).desc(), F.col("stars").desc(), "full_name").limit(max(1, min(limit, 100))).select("full_name", "rank")
