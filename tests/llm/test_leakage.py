from __future__ import annotations

import random

from tidemark.llm import leakage as k

D, I = "doc_id long, text string, item string, n string", "item_id long, text string, doc string"


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = k.words_of(t)
        for i, x in items:
            v = k.words_of(x)
            n = min(13, len(v))
            if n and any(w[a : a + n] == v[b : b + n] for b in range(len(v) - n + 1) for a in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["cache", "Cache", "straße", "данные", "数据", "7", "x_y", "don't", "हिन्दी"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n> ", "—", "_"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 12, 13, 14, 40]))) for i in range(40)] + [(90, None), (91, "..."), (92, ""), (93, items_text := say(20)), (94, items_text)]
    docs = [(i, say(rng.randrange(60))) for i in range(60)] + [(200, None), (201, ""), (202, "  —")]
    for i, x in items[:20]:
        if x:
            docs.append((300 + i, say(5) + x.upper().replace("STRASSE", "straße") + say(5)))
    docs += docs[:5]
    d = spark.createDataFrame([(a, b, "", "") for a, b in docs], D)
    q = spark.createDataFrame([(a, b, "") for a, b in items], I)
    want = brute(docs, items)
    assert len(want) > 50
    for limit in (k.MAX_BROADCAST, 0):
        got = [tuple(r) for r in k.leaked_pairs(d, q, max_broadcast=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_tables(spark):
    none_d, none_i = spark.createDataFrame([], D), spark.createDataFrame([], I)
    some_d, some_i = spark.createDataFrame([(1, "a b", "", "")], D), spark.createDataFrame([(1, "a b", "")], I)
    assert k.leaked_pairs(none_d, some_i).count() == 0 and k.leaked_pairs(some_d, none_i).count() == 0


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, f"Before, {item.upper()}! After.", "", ""), (2, "clean", "", ""), (3, None, "", "")], D)
    leaks = k.find_leaks(d, spark.createDataFrame([(7, item, "")], I))
    assert [tuple(r) for r in leaks.collect()] == [(1, 7, 1, 13)]
    assert sorted(r.doc_id for r in k.drop_leaked(d, leaks).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in k.cut_leaked(d, leaks).collect()} == {1: "Before, ! After.", 2: "clean", 3: None}


def test_letters_that_lowering_lengthens_stay_one_word():
    assert k.words_of("\u0130stanbul, Ev") == ["i\u0307stanbul", "ev"]


def test_the_map_of_bits_holds_all_hashes_and_few_others(spark):
    rng = k.np.random.default_rng(3)
    own, others = (rng.integers(-(2**63), 2**63 - 1, n) for n in (3_000, 100_000))
    marks = k.hash_bits(spark.createDataFrame([(int(h),) for h in own], "hash long"), 1 << 16)
    assert len(marks) == 1 << 10 and k._marked(marks, own.view(k.np.uint64)).all()
    assert k._marked(marks, others.view(k.np.uint64)).mean() < 0.06


def test_sizes_are_counted_in_bytes(spark, monkeypatch):
    """Few passages of very long words are joined, not broadcast."""
    monkeypatch.setattr(k, "MAX_BROADCAST", 20_000)
    called = []
    real = k.hash_bits
    monkeypatch.setattr(k, "hash_bits", lambda *a: called.append(1) or real(*a))
    text = " ".join("w" * 900 + str(i) for i in range(14))
    d = spark.createDataFrame([(1, "x " + text, "", ""), (2, "x", "", "")], D)
    q = spark.createDataFrame([(7, text, "")], I)
    assert [tuple(r) for r in k.leaked_pairs(d, q, max_broadcast=k.MAX_BROADCAST).collect()] == [(1, 7)] and called
