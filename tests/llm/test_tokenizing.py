from __future__ import annotations

import random
from pathlib import Path

import pytest

from tidemark.llm import tokenizing as t

TEXTS = [None, "", " ", "\n\n", "Hello  world", "don't we'll I'M", "a​b   c", "数据库 と ไทย हिन्दी", "x" * 5000, "🎉👩‍💻 ok", "  lead\r\n\ttabs  ", "<|endoftext|>", "1234 ½ Ⅷ", "\x00\x1c", "éé"]

pytestmark = pytest.mark.skipif(not Path(t.vocabulary_path()).exists(), reason="no vocabulary here")


def ids(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids string, block string")
    return [(r.doc_id, r.ids) for r in t.encode_corpus(df, vocabulary=t.vocabulary_path(), pattern=t.BYTE_BPE_PATTERN, **how).collect()]


def test_same_as_whole_texts_in_any_blocks(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(["the ", "cache", "\n", " 12", "…", "é", "中", ".", "  "]) for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, x, "w", "i", "b") for i, x in enumerate(texts)]
    e = t.encoder(t.read_vocabulary(t.vocabulary_path()), t.BYTE_BPE_PATTERN)
    want = {i: e.encode_ordinary(x) if x else [] for i, x in enumerate(texts)}
    assert dict(ids(spark, rows)) == want
    assert dict(ids(spark, rows, block_tokens=7)) == want
    assert dict(ids(spark, rows, block_tokens=50, frequent=3)) == want


def test_frequent_words_are_not_shuffled_to_their_ids(spark):
    rows = [(i, "the cache of the", "", "", "") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids string, block string")
    coded = t.encode_corpus(df, vocabulary=t.vocabulary_path(), pattern=t.BYTE_BPE_PATTERN, block_tokens=8)
    assert coded.count() == 40 and "BroadcastHashJoin [word" in coded._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_assembled_once_and_an_unknown_id_fails(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [])], "doc_id long, ids array<int>")
    plan = t.decode_corpus(rows.repartition(2), vocabulary=t.vocabulary_path())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    with pytest.raises(Exception, match="lacks"):
        t.decode_corpus(spark.createDataFrame([(1, [10**8])], rows.schema), vocabulary=t.vocabulary_path()).collect()


def test_rows_stay_apart_and_empty_tables_work(spark):
    rows = [(1, "a b", "", "", ""), (1, "a b", "", "", ""), (None, "c", "", "", "")]
    got = ids(spark, rows)
    assert len(got) == 3 and sorted(x[0] or 0 for x in got) == [0, 1, 1]
    assert ids(spark, []) == []


def test_round_trip(spark):
    rows = [(i, x, "", "", "") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, ids string, block string")
    coded = t.encode_corpus(df, vocabulary=t.vocabulary_path(), pattern=t.BYTE_BPE_PATTERN)
    assert {r.doc_id: r.text for r in t.decode_corpus(coded, vocabulary=t.vocabulary_path()).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    null = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in t.decode_corpus(null, vocabulary=t.vocabulary_path()).collect()} == {1: None, 2: ""}
