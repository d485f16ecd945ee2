from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display as d
from tidemark.functions import text
from tidemark.operators import leaderboard, pairs
from tidemark.sources import jsonl


def test_numbers_and_labels(spark):
    df = spark.createDataFrame([(n,) for n in (0, 999, 1234, 9_999, 10_000, 12_345, 999_949, 999_950, 1_250_000, 2_000_000_000)], "n long")
    assert [r[0] for r in df.orderBy("n").select(d.compact_number(F.col("n"))).collect()] == ["0", "999", "1,234", "9,999", "10K", "12.3K", "999.9K", "1M", "1.3M", "2B"]
    p = spark.createDataFrame([(None, None), (-1.0, 2), (0.5, 0), (0.7, -3), (9.0, 1)], "p double, m int")
    rows = p.select(d.adoption_label(F.col("p")), d.spark_tail(F.col("p")), d.movement(F.col("m")), d.percent(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["Unscored", "Hidden gem", "Durable", "Emerging", "Emerging"]
    assert [r[1] for r in rows] == [90, 80, 90, 94, 100] and [r[2] for r in rows] == ["new", "↑2", "—", "↓3", "↑1"] and rows[2][3] == 50


def test_choices_pages_and_requests(spark):
    df = spark.createDataFrame([(["a"], "b"), (["a", "b"], "a"), (["a", "b", "c"], "x"), ([], "x")], "c array<string>, n string")
    assert [r[0] for r in df.select(d.toggled(F.col("c"), F.col("n"))).collect()] == [["a", "b"], ["b"], ["a", "b", "c"], ["x"]]
    assert [spark.range(1).select(d.total_pages(F.lit(n), 25)).first()[0] for n in (0, 25, 26)] == [1, 1, 2] and d.page_offset(3, 25) == 50
    assert d.page_request(status="hidden-gem", page=0, limit=99, owner=None, window=7) == {"status": "Hidden gem", "page": 1, "limit": 50, "window": 7} and "status" not in d.page_request(status="none")
    assert d.checked_query("  ab ", 25) == ("ab", 25)
    for bad in (("a", 5), ("x" * 501, 5), ("ab", 0), ("ab", 26)):
        with pytest.raises(ValueError, match="query"):
            d.checked_query(*bad)


def test_lines_and_reasons(spark):
    df = spark.createDataFrame([(7, "o/r", 0.5, "Durable", None, "u"), (12345, "o/s", 1.0, "At risk", -2, "v")], "r int, n string, s double, l string, m int, u string")
    assert [x[0] for x in df.select(d.result_line("r", "n", "s", "l", "m", "u")).collect()] == ["0007 o/r   50.0  Durable  new\n     u", "12345 o/s  100.0  At risk  ↓2\n     v"]
    rows = spark.createDataFrame([(["a", "b", "c"], ["p"]), ([], []), (None, None)], "topics array<string>, code_evidence_paths array<string>")
    assert [x[0] for x in rows.select(text.reason()).collect()] == ["implements a, b; verified in p", *["source-level capability match"] * 2]


@pytest.mark.parametrize(("days", "want"), [(None, 90), (-5, 1), (0, 1), (1, 1), (2, 30), (7, 7), (30, 30), (89, 30), (90, 90), (500, 90)])
def test_windows(days, want):
    assert leaderboard.in_window(days) == f"adoption_{want}d"


def test_window_page_hides_archived_repositories(spark):
    scores = [f"{c}_score" for c in ("maintenance", "quality", "depth", "originality", "attention")]
    schema = "repository_id string, full_name string, score double, label string, global_rank int, explanation string, " + ", ".join(f"{c} double" for c in ("adoption_1d", "adoption_7d", "adoption_30d", "adoption_90d", *scores))
    mk = lambda i, score, rank: (str(i), f"o/r{i}", score, "Durable", rank, "{}", *[0.1 * k + 0.01 * i for k in (1, 7, 3, 9)], *[0.5] * 5)
    results = spark.createDataFrame([mk(1, 0.9, 1), mk(2, 0.8, 2), mk(3, 0.7, 3)], schema)
    repos = spark.createDataFrame([("1", False, "O", None, None), ("2", True, "O", "Go", None), ("3", False, "P", "Go", "MIT"), ("3", False, "P", "Go", "MIT")], "id string, is_archived boolean, owner string, language string, license_spdx string")
    repos = repos.selectExpr("*", "'d' as description", "1 as stars", "array('t') as topics", "timestamp_ntz'2026-01-01' as github_updated_at")
    prior = spark.createDataFrame([("o/r3", 1, 0.5)], "full_name string, prior_rank int, prior_score double")
    rows = leaderboard.window_page(results, prior, repos, window=7, sort_by="adoption").collect()
    assert [(r.full_name, r.global_rank, round(r.adoption_score, 2), r.rank_delta, r.total_count) for r in rows] == [("o/r3", 3, 0.73, -2, 2), ("o/r1", 1, 0.71, None, 2)]
    assert [r.full_name for r in leaderboard.window_page(results, prior, repos, language=" GO ").collect()] == ["o/r3"]
    assert leaderboard.window_page(results, prior, repos, language="Unknown").count() == 0  # a default is shown, not searched


def test_run_headers_keep_when_they_were_made(spark):
    cols = "feature_version string, data_watermark timestamp_ntz, model_version string, created_at timestamp_ntz"
    at = lambda n: datetime(2026, 1, n)
    old = spark.createDataFrame([("leaderboard-v1", at(1), "a", at(2)), ("leaderboard-v1", at(3), "a", at(4)), ("x", at(9), "a", at(9))], cols)
    now = leaderboard.add_headers(old, spark.createDataFrame([("leaderboard-v1", at(3), "b", at(8)), ("leaderboard-v1", at(5), "b", at(6))], cols))
    got = [(r.data_watermark.day, r.model_version, r.created_at.day, r.recency) for r in leaderboard.run_recency(now).orderBy("recency").collect()]
    assert got == [(5, "b", 6, 1), (3, "b", 4, 2), (1, "a", 2, 3)]


def test_losses_and_saved_rankers(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 0.0, 0.5, 1.0), (0.0, 0.0, 0.5, None)], "p double, n double, c double, t double")
    r = pairs.pair_losses(df, positive="p", negative="n", chance="c", target="t").first()
    assert r.pair_loss == pytest.approx((0.31326168751822286 + 0.6931471805599453) / 2) and r.adoption_loss == pytest.approx(0.6931471805599453) and r.labels == 1
    assert pairs.pair_losses(df.where("t is null"), positive="p", negative="n", chance="c", target="t").first().adoption_loss == 0.0
    weights = [float(i) for i in range(20)]
    pairs.save_ranker(spark, weights, str(tmp_path / "r"))
    assert pairs.load_ranker(spark, str(tmp_path / "r")) == weights
    spark.createDataFrame([("other", 1.0)], "feature string, weight double").write.mode("overwrite").json(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="features"):
        pairs.load_ranker(spark, str(tmp_path / "r"))
    batches = pairs.shuffled_batches(spark.range(10), key="id", seed=1, size=4).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(x) for x in batches] == [(0, 4), (1, 4), (2, 2)]


def test_items_without_values(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"full_name": "o/r", "html_url": "u", "subscribers_count": 0, "watchers_count": 5, "language": "", "license": {"spdx_id": null}, "extra": 1}\n{"full_name": "o/s", "html_url": "u", "subscribers_count": 3, "license": null}\n')
    a, b = jsonl.hydrated_items(jsonl.read_items(spark, str(tmp_path / "i.jsonl")), captured_at=F.lit(datetime(2026, 1, 1)), source_query="q").orderBy("full_name").collect()
    assert (a.watchers, a.language, a.license_spdx, a.topics, a.stars, a.archived, a.pushed_at, a.source_query) == (5, "Unknown", "NOASSERTION", [], 0, False, None, "q")
    assert b.watchers == 3 and b.license_spdx == "NOASSERTION"
