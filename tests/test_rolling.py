from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.rolling import rolling_gains
from tidemark.session import CO_PARTITION

SCHEMA = "id long, repository_id string, observed_at timestamp_ntz, stars int, forks int, downloads_30d long, day string, entity string, lag int"


def brute(rows, periods=(7, 30)):
    once = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            k = (r[1], r[2])
            if k not in once or r[0] < once[k][0]:
                once[k] = r
    out = {}
    for repo in {k[0] for k in once}:
        own = sorted((r for r in once.values() if r[1] == repo), key=lambda r: r[2])
        first, last = own[0][2].date(), own[-1][2].date()
        days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
        for m, name in ((3, "stars"), (4, "forks"), (5, "downloads_30d")):
            value = {}
            for r in own:
                if r[m] is not None:
                    value[r[2].date()] = r[m]
            gain, before = {}, None
            for d in days:
                if d in value:
                    gain[d] = 0 if before is None else value[d] - before
                    before = value[d]
            for i, d in enumerate(days):
                for p in periods:
                    window = days[max(0, i - p + 1) : i + 1]
                    total = sum(gain.get(x, 0) for x in window)
                    out[repo, d, name, p] = (total, total / len(window))
    return out


def test_against_brute_force(spark):
    rng, start, rows = random.Random(3), datetime(2026, 1, 1), []
    for i in range(400):
        some = lambda: rng.choice([None, rng.randrange(100)])
        at = None if rng.random() < 0.02 else start + timedelta(hours=rng.randrange(24 * 80))
        rows.append((i, rng.choice([None, "a", "a", "a", "b", "c"]), at, some(), some(), some(), "x", "y", 1))
    rows += rng.sample(rows, 40)  # delivered again
    got = rolling_gains(spark.createDataFrame(rows, SCHEMA))
    seen = {}
    for r in got.collect():
        for p in (7, 30):
            assert (r.repository_id, r.day, r.metric, p) not in seen
            seen[r.repository_id, r.day, r.metric, p] = (r[f"total_{p}"], r[f"average_{p}"])
    want = brute(rows)
    assert seen.keys() == want.keys()
    assert all(seen[k][0] == want[k][0] and abs(seen[k][1] - want[k][1]) < 1e-9 for k in want)


def test_empty_and_single(spark):
    assert rolling_gains(spark.createDataFrame([], SCHEMA)).count() == 0
    one = rolling_gains(spark.createDataFrame([(1, "a", datetime(2026, 1, 1, 5), None, 3, 4, "", "", 0)], SCHEMA))
    assert one.count() == 3 and one.agg(F.sum("total_30")).first()[0] == 0


def test_one_scan_and_two_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(CO_PARTITION, "false")
    try:
        rows = [(i, "a" if i % 3 else "b", datetime(2026, 1, 1 + i % 28), i, i, i, "", "", 0) for i in range(200)]
        df = rolling_gains(spark.createDataFrame(rows, SCHEMA))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set(CO_PARTITION, "true")
    assert "SortMergeJoin" in plan and plan.count("- Exchange hashpartitioning") == 2 and "ReusedExchange" in plan
