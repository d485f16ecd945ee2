from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import growth
from tidemark.operators import leaderboard as board
from tidemark.operators.leaderboard import page
from tidemark.operators.ranking import global_rank, percentiles

OBS = "id long, repository_id string, source string, observed_at timestamp_ntz, stars int, forks int, downloads_30d long, open_issues int"


@pytest.mark.parametrize(("values", "want"), [([10.0, 10.0, 30.0], [0.25, 0.25, 1.0]), ([7.0], [0.5]), ([1.0, 2.0, 2.0, 2.0, None], [0.25, 2 / 3 + 1 / 12, 0.75, 0.75, 0.0])])
def test_percentiles(spark, values, want):
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = [r.p for r in percentiles(df, "k", {"v": "p"}).orderBy("k").collect()]
    assert got == pytest.approx(want)


def test_global_rank_is_total(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    rows = global_rank(df, [F.col("v").desc(), F.col("id").asc()], "r").orderBy("r").collect()
    assert [r.r for r in rows] == list(range(1, 1001))
    assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))


def test_growth_golden(spark):
    now = datetime(2026, 2, 1)
    rows = [(1, "a", "github", now - timedelta(days=7), 100, 10, 1000, 0), (2, "a", "github", now, 128, 14, 1600, 0), (3, "b", "github", now, 5, 5, 5, 0), (4, "c", "github", now - timedelta(days=1), 9, 9, 9, 9), (5, "c", "github", now, 2, None, 4, 0)]
    got = {r.repository_id: r for r in growth.growth(growth.history(spark.createDataFrame(rows, OBS))).collect()}
    assert (got["a"].stars_gain_7d, got["a"].forks_gain_7d, got["a"].downloads_30d_gain_7d) == (28, 4, 600)
    assert got["a"].growth_7d > 0 and got["b"].growth_7d == 0.0 and got["c"].stars_gain_1d == 0 and got["c"].growth_1d == 0.0


def test_page_bounds(spark):
    cols = "item_id long, full_name string, owner string, language string, license string, status string, description string, stars int, score double, adoption_score double, maintenance_score double, quality_score double, depth_score double, originality_score double, attention_score double, global_rank int, rank_delta int, score_delta double, data_watermark timestamp_ntz"
    mk = lambda i, day, score: (i, f"o/r{i % 3}", "O", None, None, "Durable", None, i, score, *[0.1] * 6, 1 + i % 3, None, None, datetime(2026, 4, day))
    df = spark.createDataFrame([mk(0, 1, 0.5), mk(1, 1, 0.4), mk(3, 8, 0.7), mk(4, 8, None), mk(5, 8, 0.6)], cols)
    rows = page(df, owner=" o ").collect()
    assert [r.full_name for r in rows] == ["o/r0", "o/r2", "o/r1"] and {r.total_count for r in rows} == {3}
    assert rows[0].score_delta == pytest.approx(0.2) and rows[1].rank_delta is None and rows[0].language == "Unknown"
    assert page(df, offset=10).count() == 0 and page(df, owner="nobody").count() == 0


def test_response_body_fills_numbers_and_keeps_null_deltas(spark):
    scores = [f"{c}_score" for c in ("adoption", "maintenance", "quality", "depth", "originality", "attention")]
    schema = "item_id long, full_name string, owner string, name string, description string, language string, license string, stars int, forks int, score double, confidence double, global_rank int, rank_delta int, score_delta double, fullName_ string, " + ", ".join(f"{c} double" for c in scores)
    df = spark.createDataFrame([(1, "o/n", "o", "n", *[None] * (11 + len(scores)))], schema)
    (row,) = board.response_body(df).collect()
    assert (row.fullName, row.description, row.language, row.license) == ("o/n", "", "Unknown", "NOASSERTION")
    assert (row.stars, row.score, row.globalRank, row.adoptionScore) == (0, 0.0, 0, 0.0) and row.rankDelta is None and row.scoreDelta is None
    assert board.response_body(df.limit(0)).count() == 0
