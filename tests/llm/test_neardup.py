from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import neardup as nd


def shingles(text, width):
    w = re.findall(r"[a-z0-9_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def make():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 30, 90]))) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        for _ in range(rng.choice([0, 1, 3])):
            v = list(w)
            for _ in range(rng.randrange(1 + len(v) // 8)):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v))
    texts += texts[:30] + [None, "", "É é", "tail only"]
    return list(enumerate(texts))


def test_pairs_against_brute_force(spark):
    rows = make()
    for width, threshold in ((3, 0.6), (5, 0.8)):
        sets = {i: s for i, t in rows if (s := shingles(t, width))}
        ids = sorted(sets)
        want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
        df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], "rid long, txt string, id int, wanted_id string")
        for how in ({}, {"block": 3}, {"small": 20}):  # bands in cells; records of both sizes
            members, links = nd.near_duplicates(df, id="rid", text=F.col("txt"), threshold=threshold, width=width, **how)
            assert {tuple(r) for r in nd.record_pairs(members, links).collect()} == want
        got = [tuple(r) for r in nd.record_pairs(members, links).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
        classes = nd.record_classes(members, links).collect()
        assert sorted(r.id for r in classes) == ids and all(r.class_id <= r.id for r in classes)


def test_empty(spark):
    members, links = nd.near_duplicates(spark.createDataFrame([], "id long, t string"), id="id", text=F.col("t"))
    assert members.count() == 0 and links.count() == 0 and nd.record_pairs(members, links).count() == 0


def test_signature_agreement_estimates_likeness():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300).astype(np.uint64)])
    sig = nd.signatures(np.concatenate([a, b, a[:1]]), np.array([0, 900, 1800]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    long = rng.integers(0, 2**63, 200_000).astype(np.uint64)  # goes through in slices
    assert (nd.signatures(long, np.array([0]), 8)[0] == nd.signatures(long[::-1].copy(), np.array([0]), 8)[0]).all()


def test_pairs_of_a_hot_band_meet_once_and_in_small_cells(spark):
    df = spark.range(500).select("id", F.lit(7).cast("long").alias("band")).union(spark.createDataFrame([(900, 8), (901, 8), (902, 9)], "id long, band long"))
    got = [tuple(r) for r in nd._meetings(df, 20).collect()]
    assert len(got) == len(set(got)) == 500 * 499 // 2 + 1 and (900, 901) in got
    assert sorted(got) == sorted(tuple(r) for r in nd._meetings(df, 1000).collect())


def test_large_records_that_share_nothing_are_no_candidates():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, 300_000).astype(np.uint64) for _ in range(4)]
    sets.append(np.concatenate([sets[0][:270_000], rng.integers(0, 2**63, 30_000).astype(np.uint64)]))
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = nd._keys(nd.large_signatures(np.concatenate(sets), starts, 144), 48, 3, 1)
    alike = {(a, b) for a in range(5) for b in range(a) if (keys[a] == keys[b]).any()}
    assert alike == {(4, 0)}


def test_large_permutation_is_one():
    p = nd._large_coordinates(np.array([5]), 2000, 7)
    assert len(set(p.tolist())) == 2000 and p.max() < nd.LARGE_UNIVERSE
