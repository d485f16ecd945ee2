from __future__ import annotations

import random
from datetime import datetime

from tidemark.llm.topn import top_repositories

SCHEMA = "item_id long, full_name string, owner string, language string, score double, global_rank int, data_watermark timestamp_ntz, place int, x int"


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        name = rng.choice([None] + [f"o/r{k}" for k in range(150)])
        rows.append((i, name, rng.choice(["A", "a", "b", None]), rng.choice(["Go", "go", None, "Unknown"]), rng.choice([None, 0.5, 0.5, 0.7, -1.0]), rng.choice([None, 1, 2, 3]), datetime(2026, 4, rng.choice([1, 8])), 0, 0))
    rows += rng.sample(rows, 60)
    latest = {}
    for r in rows:
        if r[1] is not None and (r[1] not in latest or (r[6], r[0]) > (latest[r[1]][6], latest[r[1]][0])):
            latest[r[1]] = r
    groups = {}
    for r in latest.values():
        groups.setdefault((r[2].lower() if r[2] else None, (r[3] or "Unknown").lower()), []).append(r)
    want = set()
    for (o, g), v in groups.items():
        v.sort(key=lambda r: (-(r[4] or 0), r[5] is None, r[5] or 0, r[1]))
        want |= {(o, g, r[1], i + 1) for i, r in enumerate(v[:3])}
    got = [tuple(r) for r in top_repositories(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert top_repositories(spark.createDataFrame([], SCHEMA)).count() == 0


def test_group_limit_prunes_before_the_shuffle(spark):
    plan = top_repositories(spark.createDataFrame([(1, "o/r", "o", "go", 1.0, 1, datetime(2026, 1, 1), 0, 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
