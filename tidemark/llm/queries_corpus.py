"""Queries of the top items, the near-duplicates, the token ids and the leaked evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leakage, neardup, tokenizing, topn
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()


def snapshot_duplicates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Indexed snapshots, alike from a likeness of 0.6 over runs of three words, as TESTDATA.md defines it."""
    rows = table(spark, folder, "repository_snapshots").select("snapshot_id", "code_chunks").where(F.size("code_chunks") > 0)
    return neardup.near_duplicates(rows, id="snapshot_id", text=F.array_join("code_chunks", " "), threshold=0.6, width=3)


_P3_WORDS = """
with w as (
  select snapshot_id as id, regexp_extract_all(lower(array_to_string(code_chunks, ' ')), '[a-z0-9_]+') as words
  from repository_snapshots where len(code_chunks) > 0),
"""
_P3_LIKE = """
s as (
  select distinct id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)),
n as (select id, count(*) as n from s group by id),
c as (select a.id as a, b.id as b, count(*) as shared from s a join s b on a.g = b.g and a.id < b.id group by all),
p as (select a, b from c join n x on x.id = a join n y on y.id = b where shared::double / (x.n + y.n - shared) >= 0.6)
"""


@R.query("p3_found", _P3_WORDS + _P3_LIKE + "select a as snapshot_id_a, b as snapshot_id_b from p")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of indexed snapshots whose code chunks are mostly the same."""
    pairs = neardup.record_pairs(*snapshot_duplicates(spark, folder))
    return pairs.select(F.col("id_a").alias("snapshot_id_a"), F.col("id_b").alias("snapshot_id_b"))


_P3_CLASSES = """
k as (select id, min(id) over (partition by words) as class_id, words from w where len(words) >= 3),
"""


@R.query(
    "p3_classes",
    _P3_WORDS + _P3_CLASSES + _P3_LIKE.replace("from w where", "from k where id = class_id and")
    + """, e as (select id, count(*) as links from (select a as id from p union all select b from p) group by id)
    select k.id as snapshot_id, class_id, coalesce(links, 0) as links from k left join e on e.id = class_id""",
)
def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each indexed snapshot with its class of equal texts and the number of other classes that are mostly the same."""
    return neardup.record_classes(*snapshot_duplicates(spark, folder)).withColumnRenamed("id", "snapshot_id")


_P5_SQL = """
with last as (
  select full_name, arg_max(struct_pack(o := owner, l := language, s := score, g := global_rank), row(data_watermark, item_id)) as x
  from leaderboard_items where full_name is not null group by full_name),
ranked as (
  select lower(x.o) as owner, lower(coalesce(x.l, 'Unknown')) as language, full_name,
    row_number() over (partition by lower(x.o), lower(coalesce(x.l, 'Unknown')) order by coalesce(x.s, 0) desc, x.g asc nulls last, full_name) as place
  from last)
"""


@R.query("p5_found", _P5_SQL + "select owner, language, full_name from ranked where place <= 3")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three best repositories of every owner and language."""
    return topn.top_repositories(table(spark, folder, "leaderboard_items")).drop("place")


@R.query("p5_top10", _P5_SQL + "select owner, language, full_name, cast(place as integer) as place from ranked where place <= 10")
def p5_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best repositories of every owner and language, with their places."""
    return topn.top_repositories(table(spark, folder, "leaderboard_items"), n=10)


@R.query("p6_ids")
def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizing.encode_corpus(table(spark, folder, "documents"), vocabulary=tokenizing.vocabulary_path(), pattern=tokenizing.BYTE_BPE_PATTERN)


@R.query("p6_decoded", "select doc_id, coalesce(text, '') as text from documents")
def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' texts, decoded from their token ids; null and empty texts are empty."""
    return tokenizing.decode_corpus(p6_ids(spark, folder), vocabulary=tokenizing.vocabulary_path())


#: Windows of 13 words, or all words of a shorter item, of items and documents, and where they are the same.
_P7_SQL = """
with iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') as w from eval_items where text is not null),
ig as (select distinct item_id, n, list_slice(w, k, k + n - 1) as g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k from (select *, least(13, len(w)) as n from iw where len(w) > 0))),
dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') as w from documents where text is not null),
dg as (select distinct doc_id, n, list_slice(w, k, k + n - 1) as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from dw, (select distinct n from ig) where len(w) >= n)),
found as (select distinct doc_id, item_id from dg join ig on dg.n = ig.n and dg.g = ig.g)
"""


@R.query("p7_found", _P7_SQL + "select doc_id, item_id from found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with each evaluation item of which it holds a passage."""
    return leakage.leaked_pairs(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@R.query("p7_kept", _P7_SQL + "select doc_id, lang, source from documents where doc_id not in (select doc_id from found)")
def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents into which no evaluation item leaked."""
    docs = table(spark, folder, "documents")
    return leakage.drop_leaked(docs.select("doc_id", "lang", "source"), leakage.leaked_pairs(docs, table(spark, folder, "eval_items")))


@R.query("p7_cut")
def p7_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the leaked passages."""
    docs = table(spark, folder, "documents")
    return leakage.cut_leaked(docs, leakage.find_leaks(docs, table(spark, folder, "eval_items")))
