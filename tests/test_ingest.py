from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, pairs, search
from tidemark.plans.search import R
from tidemark.schemas import with_defaults
from tidemark.sources import jsonl
from tidemark.streaming import ingest as streaming


def test_upsert_and_inserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, name string, v string")
    new = spark.createDataFrame([(2, "no", None), (3, "c", "z")], "k int, name string, v string")
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "b", None), (3, "c", "z")]
    assert sorted(map(tuple, ingest.update_matched(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "b", None)]
    twice = spark.createDataFrame([(2, "n", "q"), (4, "s", "1"), (4, "t", "0"), (None, "u", "u"), (None, "w", "w")], "k int, name string, v string")
    got = ingest.insert_if_absent(old, twice, ["k"], order="v").collect()
    assert sorted((r.k or 0, r.name) for r in got) == [(0, "u"), (0, "w"), (1, "a"), (2, "b"), (4, "t")]


def test_ties_of_latest(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3)], "k string, at int, n int")
    pick = lambda first: ingest.latest_per_key(df, key=F.col("k"), at="at", order="n", first_on_ties=first).first().n
    assert (pick(True), pick(False)) == (2, 3)


def test_partitions_are_replaced(spark, tmp_path):
    at = str(tmp_path / "t")
    ingest.replace_partitions(spark.createDataFrame([(1, "x"), (2, "y")], "v int, p string"), at, "p")
    ingest.replace_partitions(spark.createDataFrame([(9, "y")], "v int, p string"), at, "p")
    assert sorted((r.v, r.p) for r in spark.read.parquet(at).collect()) == [(1, "x"), (9, "y")]


def test_landed_lines(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    f.write_text('{"full_name": "o/r", "html_url": "u", "captured_at": "2026-01-01T00:00:00", "stars": 3, "else": 1}\n\n')
    r = jsonl.read_snapshots(spark, [str(f)]).first()
    assert (r.stars, r.forks, r.language, r.topics, r.pypi_package) == (3, 0, "Unknown", [], None)
    f.write_text('{"html_url": "u", "captured_at": "2026-01-01T00:00:00"}\n')
    with pytest.raises(Exception, match="lacks full_name"):
        jsonl.read_snapshots(spark, [str(f)]).collect()
    q = tmp_path / "q.txt"
    q.write_text("# no\n  fast parser  \n\n # kept\n")
    assert [x.query for x in jsonl.read_seed_queries(spark, str(q)).collect()] == ["fast parser", "# kept"]
    assert with_defaults(spark.createDataFrame([], "full_name string, html_url string, captured_at timestamp_ntz, topics array<string>, code_terms array<string>, code_evidence_paths array<string>, code_chunks array<string>")).count() == 0


def test_package_names(spark):
    got = jsonl.package_names(spark.createDataFrame([("a_b",), ("c-d",), ("e",)], "name string"), spark.createDataFrame([("a-b",), ("c_d",), ("c-d",)], "package string"))
    assert sorted(map(tuple, got.collect())) == [("a_b", "a-b"), ("c-d", "c-d")]


def test_pair_metrics_count_ties_as_wrong(spark):
    r = pairs.pair_metrics(spark.createDataFrame([(2.0, 1.0), (1.0, 1.0)], "p double, n double"), positive="p", negative="n").first()
    assert r.accuracy == 0.5 and r.ndcg == pytest.approx((1 + 0.6309297535714575) / 2)


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "fast cache"), (2, None), (3, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cache cache"), (2, None)], "query_id long, query string")
    rows = search.bm25(docs, queries).collect()
    assert [(r.query, r.doc) for r in rows] == [(1, 1)]
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<double>")
    got = search.nearest(v, v.where("vec_id = 0"), id="vec_id", vector="embedding", k=2, block=2).orderBy("place").collect()
    assert [r.id for r in got] == [1, 2]


def test_every_search_has_its_result(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(20, "s", "en", "fast cache"), (30, "s", "en", "no query"), (40, "s", "en", "slow disk")], "item_id long, suite string, lang string, text string").write.parquet(f"{at}/eval_items.parquet")
    spark.createDataFrame([(i, "web", None, f"{w} {w}", 9) for i, w in ((1, "cache"), (20, "word"), (40, "disk"))], "doc_id long, source string, lang string, text string, n_chars int").write.parquet(f"{at}/documents.parquet")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (20, [1.0, 1.0]), (40, [0.0, 2.0]), (60, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    vectors.write.parquet(f"{at}/embeddings.parquet")
    rows = lambda name: R.queries[name](spark, at).collect()
    assert {(r.query, r.doc) for r in rows("hybrid_top50_all") if r.place == 1} == {(20, 1), (40, 40)}
    assert {(r.query, r.rank) for r in rows("blend_final_all")} == {(q, k) for q in (20, 40) for k in (1, 2, 3)}
    assert sorted((r.query, r.similarity) for r in rows("semantic_by_source_all")) == [(20, 1.0), (40, 1.0), (60, 0.0)]
    vectors.where("vec_id <> 40").write.parquet(f"{at}/less/embeddings.parquet")
    for t in ("eval_items", "documents"):
        spark.read.parquet(f"{at}/{t}.parquet").write.parquet(f"{at}/less/{t}.parquet")
    with pytest.raises(Exception, match="no vector for item 40"):
        R.queries["hybrid_top50_all"](spark, f"{at}/less").collect()


def test_full_text(spark):
    rows = [("o/vector-db", "searching things", ["cache"], 5, False), ("o/other", "search engines", [], 9, False), ("o/gone", "vector search", [], 1, True)]
    df = spark.createDataFrame(rows, "full_name string, description string, topics array<string>, stars int, is_archived boolean")
    assert [r.full_name for r in search.full_text(df, "search engine or vector -db").collect()] == ["o/other"]


def test_stream_replays_nothing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    event = lambda i, day: json.dumps({"event_id": str(i), "source": "github", "captured_at": f"2026-01-0{day}T00:00:00Z", "full_name": "o/r", "html_url": "u"})
    (src / "1.json").write_text("\n".join([event(1, 1), event(2, 1), event(3, 2), event(4, 2).replace("o/r", "bad")]))
    run = lambda: streaming.ingest(streaming.read_events(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    (src / "2.json").write_text("\n".join([event(5, 2), event(6, 3)]))
    run()
    run()
    days = sorted(str(r.captured_at)[:10] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert days == ["2026-01-01", "2026-01-02", "2026-01-03"]


def test_streams_keep_late_events_of_later_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    event = lambda i, at: json.dumps({"event_id": str(i), "source": "github", "captured_at": f"2026-{at}:00:00Z", "full_name": "o/r", "html_url": "u"})
    for k, rows in enumerate([[(1, "06-01T10"), (2, "06-01T12")], [(3, "01-01T05")], [(4, "06-01T11"), (5, "01-01T04"), (6, "06-02T00")], [(3, "01-01T05")]]):
        (src / f"{k}.json").write_text("\n".join(event(*r) for r in rows))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    read = lambda: streaming.read_events(spark, str(src), files_per_trigger=1)
    streaming.ingest(read(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3", "4", "5", "6"]
    daily, state = str(tmp_path / "daily"), tmp_path / "daily-state"
    want = [("2026-01-01", "3", 3), ("2026-06-01", "2", 3), ("2026-06-02", "6", 1)]
    days = lambda: sorted((str(r.day)[:10], r.event_id, r.events) for r in streaming.latest_days(spark, daily).collect())
    streaming.daily_latest(read(), daily, str(state))
    assert days() == want
    for f in (state / "commits").glob("*3*"):  # the last batch is replayed
        f.unlink()
    streaming.daily_latest(read(), daily, str(state))
    assert days() == want
