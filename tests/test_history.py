from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history

SCHEMA = "sid long, name string, at timestamp_ntz, lic string, arch boolean, key string, digest string"


def take(df, only=None):
    return history.captures(df, key=F.lower("name"), at="at", order="sid", attributes={"lic": F.coalesce("lic", F.lit("NONE")), "arch": F.coalesce("arch", F.lit(False))}, only=only)


def caps(spark, rows, only=None):
    return take(spark.createDataFrame(rows, SCHEMA), only)


def brute(rows):
    once = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and (k := (r[1].lower(), r[2])) not in once or r[1] is not None and r[2] is not None and r[0] > once[k][0]:
            once[r[1].lower(), r[2]] = r
    out = []
    for name in {k[0] for k in once}:
        was = start = None
        for (_, at), r in sorted((k, v) for k, v in once.items() if k[0] == name):
            v = (r[3] or "NONE" if r[3] is None else r[3], bool(r[4]))
            if v != was:
                if was is not None:
                    out.append((name, start, at, *was))
                was, start = v, at
        out.append((name, start, None, *was))
    return sorted(out, key=str)


def make(n=500, seed=1):
    rng, start = random.Random(seed), datetime(2025, 11, 3)
    rows = [(i, rng.choice(["A/x", "a/X", "b/y", "b/y", None]), rng.choice([None] + [start + timedelta(days=rng.randrange(200))] * 20), rng.choice([None, "", "MIT", "ISC"]), rng.choice([None, True, False, False]), "k", "d") for i in range(n)]
    return rows + rng.sample(rows, 30)


def show(df):
    return sorted(((r.key, r.valid_from, r.valid_to, r.lic, r.arch) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = make()
    got = history.build_history(caps(spark, rows))
    assert show(got) == brute(rows)
    assert got.where("is_current <> (valid_to is null)").count() == 0


def test_merge_equals_rebuild(spark):
    rows = make(seed=2)
    all_ = caps(spark, rows)
    cut = datetime(2026, 2, 1)
    merged = history.merge_history(history.build_history(all_.where(F.col("at") < cut)), all_.where(F.col("at") >= cut))
    assert show(merged) == brute(rows)


def full(df):
    return sorted(((r.key, r.valid_from, r.valid_to, r.is_current, r.seen_at, r.lic, r.arch) for r in df.collect()), key=str)


def test_late_captures_rebuild_their_key(spark):
    """Batches in the order of arrival, of which most hold captures older than, or at the instant of, what was seen before."""
    rows = make(seed=3, n=240)
    df = spark.createDataFrame(rows, SCHEMA)
    got = history.history_by_batches(df, batch=F.when(F.col("sid") >= 40, F.floor(F.col("sid") / 60)), take=take)
    assert show(got) == brute(rows) and full(got) == full(history.build_history(take(df)))


def test_late_returning_and_equal_instants(spark):
    day = lambda n: datetime(2026, 1, n)
    cap = lambda i, n, x: (i, "a/b", day(n), x, False, "", "")
    first = [cap(1, 1, "A"), cap(2, 9, "A"), (3, "c/d", day(1), "A", False, "", "")]
    for batch, want in (
        ([cap(4, 5, "B")], [(1, 5, "A"), (5, 9, "B"), (9, None, "A")]),  # splits a version that returns
        ([cap(4, 9, "B")], [(1, 9, "A"), (9, None, "B")]),  # the instant of the last capture, delivered again
        ([cap(4, 12, "A")], [(1, None, "A")]),  # nothing new
        ([cap(4, 12, "B"), cap(5, 14, "A")], [(1, 12, "A"), (12, 14, "B"), (14, None, "A")]),  # returns within the batch
        ([], [(1, None, "A")]),
    ):
        merged = history.merge_history(history.build_history(caps(spark, first)), caps(spark, batch), log=lambda keys, all_=first + batch: caps(spark, all_, keys))
        got = [(r.valid_from.day, r.valid_to and r.valid_to.day, r.lic) for r in merged.where("key = 'a/b'").orderBy("valid_from").collect()]
        assert got == want and merged.where("key = 'c/d' and is_current").count() == 1
        assert full(merged) == full(history.build_history(caps(spark, first + batch)))


def test_late_captures_without_a_log_fail(spark):
    first, batch = [(1, "a/b", datetime(2026, 1, 9), "A", False, "", "")], [(2, "a/b", datetime(2026, 1, 5), "B", False, "", "")]
    with pytest.raises(ValueError, match="log"):
        history.merge_history(history.build_history(caps(spark, first)), caps(spark, batch))


def test_empty(spark):
    assert history.build_history(caps(spark, [])).count() == 0
    assert history.merge_history(history.build_history(caps(spark, [])), caps(spark, [])).count() == 0


def test_values_are_compared_apart(spark):
    at = datetime(2026, 1, 1)
    rows = [(1, "a/b", at, "M1:", False, "", ""), (2, "a/b", at + timedelta(days=1), "M", False, "", "")]
    assert history.build_history(caps(spark, rows)).count() == 2
