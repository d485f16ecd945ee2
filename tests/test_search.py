from __future__ import annotations

import math
import random

import pytest

from tidemark.operators import pairs, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1) for i in range(120)] + [(500, None, 1), (501, [0.0] * 8, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids int")


@pytest.mark.parametrize("max_bytes", [search.MAX_QUERY_BYTES, 0])
def test_nearest_against_brute_force(vectors, max_bytes):
    rows, df = vectors
    known = {i: v for i, v, _ in rows if v}
    length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    like = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / length(a) / length(b)
    want = {}
    for q in range(0, 120, 20):
        best = sorted(((-round(like(known[q], v), 5), i) for i, v in known.items() if i != q))[:5]
        want[q] = {i for _, i in best}
    got = {}
    for r in search.nearest(df, df.where("vec_id % 20 = 0 and vec_id < 200"), id="vec_id", vector="embedding", k=5, block=16, max_bytes=max_bytes).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == want


def test_bm25_counts_documents_without_a_hit(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma " * 6), (3, None), (4, ""), (5, "alpha alpha")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "alpha alpha delta")], "query_id long, query string")
    n, mean, df = 5, (2 + 6 + 0 + 0 + 2) / 5, 2
    score = lambda tf, size: 2 * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    got = {r.doc: r.bm25 for r in search.bm25(docs, q).collect()}
    assert got.keys() == {1, 5} and abs(got[1] - score(1, 2)) < 1e-9 and abs(got[5] - score(2, 2)) < 1e-9


def test_pools_are_pruned_before_the_shuffle(spark):
    rows = [(i, f"o/r{i}", "Go", f"repo {i} text", None, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "snapshot_id long, full_name string, language string, description string, archived boolean, stars int")
    df = df.selectExpr("*", "timestamp_ntz'2026-01-01' as captured_at", "array('a', 'b') as topics", "array('t') as code_terms", "array('p') as code_evidence_paths", "'' as architecture_summary")
    found = pairs.hard_negatives(df, positives=pairs.F.lit(True))
    assert found.groupBy("positive").count().where("count <> 3").count() == 0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 3


def test_stems(spark):
    pairs_ = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky",
              "relational": "relat", "conditional": "condit", "digitizer": "digit", "vectorization": "vector", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "parsers": "parser", "caching": "cach", "cache": "cach", "libraries": "librari"}
    got = spark.createDataFrame([(w,) for w in pairs_], "w string").select("w", search.stems("w").alias("s")).collect()
    assert {r.w: r.s[0] for r in got} == pairs_
    row = spark.createDataFrame([("The cats, and a dog's 2 toys", None)], "a string, b string").select(search.stems("a").alias("a"), search.stems("b").alias("b")).first()
    assert row.a == ["cat", "dog", "2", "toi"] and row.b == []


def test_searches_are_parsed():
    show = lambda q: [[("-" if t.excluded else "") + t.words for t in o] for o in search.parsed(q)]
    assert show('Fast "vector  search" or cli -"note book" -the parser') == [["fast", "vector search"], ["cli", "-note book", "parser"]]
    assert show("") == show("the or of") == show('" "') == []


def test_full_text_by_phrase_alternative_and_exclusion(spark):
    rows = [("o/vector-search", "Searches vectors", ["cli"], False, 5), ("o/search-vector", "Parsing tools", [], False, 9), ("o/old-vector-search", "", [], True, 99), ("o/parser", "parse notebooks", None, False, 1), ("o/none", None, None, False, 1)]
    df = spark.createDataFrame(rows, "full_name string, description string, topics array<string>, is_archived boolean, stars int")
    names = lambda q: [r.full_name for r in search.full_text(df, q).collect()]
    assert names('"vector search"') == ["o/vector-search"] and names("searching vectors") == ["o/vector-search", "o/search-vector"]
    assert names("parse -notebook") == ["o/search-vector"] and names("cli or parsers") == ["o/parser", "o/vector-search"] and names("the") == []
