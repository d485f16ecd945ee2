"""Queries of lexical, dense and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fulltext import parsed, stems_sql
from tidemark.functions.text import tokens
from tidemark.operators import leaderboard, search
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()

_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_+.-]{{1,}}')"
_DOCS = f"d as (select doc_id as doc, coalesce({_TOKENS.format('text')}, []) as w from documents)"
#: The searches: every evaluation item whose id is divisible by 20, against all documents.
_BM25 = f"""with {_DOCS},
q as (select query, term, count(*) as times from (select item_id as query, unnest({_TOKENS.format('text')}) as term from eval_items where item_id % 20 = 0) group by all),
st as (select count(*) as n, avg(len(w)) as mean from d), tf as (select doc, size, term, count(*) as tf from (select doc, len(w) as size, unnest(w) as term from d) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
lex as (select query, doc, sum(times * ln(1.0e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * size / greatest(1.0e0, mean)))) as bm25 from tf join q using (term) join df using (term) cross join st group by all)"""


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@R.query("tokenize_docs", f"select doc_id, len(w) as n, array_to_string(w, ' ') as tokens from (select doc_id, coalesce({_TOKENS.format('text')}, []) as w from documents)")
def tokenize_docs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("tokens"))


@R.query("doc_freq", f"with {_DOCS} select term, count(*) as df from (select distinct doc, unnest(w) as term from d) group by term")
def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return search.document_frequency(table(spark, folder, "documents"), doc="doc_id", text="text")


@R.query("bm25_search", _BM25 + "select * from (select query, doc, round(bm25, 6) as bm25, row_number() over (partition by query order by round(bm25, 9) desc, doc) as place from lex) where place <= 10")
def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.top_k(search.bm25(table(spark, folder, "documents"), _queries(spark, folder)), query="query", doc="doc", score="bm25", k=10)
    return rows.select("query", "doc", F.round("bm25", 6).alias("bm25"), F.col("place").cast("long"))


@R.query("bm25_context", _BM25.replace("select item_id as query, unnest(", "select item_id as query, unnest(").replace("lower(text)", "lower(text || ' Project context: ' || lang || ' ' || suite)", 2).replace("lower(text || ' Project context: ' || lang || ' ' || suite)", "lower(text)", 1)
  + "select * from (select query, doc, round(bm25, 6) as bm25, row_number() over (partition by query order by round(bm25, 9) desc, doc) as place from lex) where place <= 10")
def bm25_context(spark: SparkSession, folder: str) -> DataFrame:
    """Search with the query expanded by a context, whose repeated terms count again."""
    q = table(spark, folder, "eval_items").where("item_id % 20 = 0")
    q = q.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.concat("text", F.lit(" Project context:")), "lang", "suite").alias("query"))
    rows = search.top_k(search.bm25(table(spark, folder, "documents"), q), query="query", doc="doc", score="bm25", k=10)
    return rows.select("query", "doc", F.round("bm25", 6).alias("bm25"), F.col("place").cast("long"))


_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])))"


@R.query("cosine_topk", f"""with s as (select a.vec_id as query, b.vec_id as id, {_COS} as similarity from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select * from (select query, id, round(similarity, 6) as similarity, row_number() over (partition by query order by round(similarity, 9) desc, id) as place from s) where place <= 10""")  # fmt: skip
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings")
    rows = search.nearest(vectors, vectors.where("vec_id % 20 = 0"), id="vec_id", vector="embedding", k=10)
    return rows.select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long"))


@R.query("semantic_by_source", f"""select d.source, coalesce(d.lang, '') as lang, round(max({_COS}), 6) as similarity from embeddings b join documents d on d.doc_id = b.vec_id
  cross join (select embedding from embeddings order by vec_id limit 1) a group by all""")  # fmt: skip
def semantic_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The best similarity to the first vector within each source and language."""
    vectors = table(spark, folder, "embeddings")
    first = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    docs = table(spark, folder, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("")).alias("lang"))
    rows = vectors.join(docs, vectors["vec_id"] == docs["doc_id"]).join(F.broadcast(first))
    return rows.groupBy("source", "lang").agg(F.round(F.max(search.cosine(F.col("q"), F.col("embedding"))), 6).alias("similarity"))


@R.query("semantic_by_source_all", f"""select a.vec_id as query, d.source, coalesce(d.lang, '') as lang, round(max({_COS}), 6) as similarity from embeddings a join embeddings b on a.vec_id % 20 = 0 join documents d on d.doc_id = b.vec_id
  group by all""")  # fmt: skip
def semantic_by_source_all(spark: SparkSession, folder: str) -> DataFrame:
    """The best similarity to every vector whose id is divisible by 20, within each source and language."""
    vectors = table(spark, folder, "embeddings")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", F.coalesce("lang", F.lit("")).alias("lang"))
    rows = search.similarities(vectors, vectors.where("vec_id % 20 = 0"), id="vec_id", vector="embedding").join(docs, "id")
    return rows.groupBy("query", "source", "lang").agg(F.round(F.max("similarity"), 6).alias("similarity"))


_HYBRID = f"""{_BM25.replace('item_id % 20 = 0', "item_id = 20")},
v as (select {{q}} as query, b.vec_id as doc, {_COS} as cosine from embeddings b cross join (select embedding from embeddings order by vec_id limit 1) a where b.vec_id in (select doc_id from documents)),
hy as (select v.query, v.doc, 0.45e0 * coalesce(bm25, 0.0e0) / greatest(1e-6, (select max(bm25) from lex)) + 0.55e0 * (cosine + 1.0e0) / 2.0e0 as hybrid from v left join lex on lex.doc = v.doc),
pl as (select *, row_number() over (order by round(hybrid, 9) desc, doc) as place from hy)""".replace("{q}", "20")


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    vectors, docs = table(spark, folder, "embeddings"), table(spark, folder, "documents")
    first = vectors.orderBy("vec_id").limit(1).select(F.lit(20).cast("long").alias("query"), F.col("embedding").alias("q"))
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").join(F.broadcast(first))
    dense = known.select("query", F.col("vec_id").alias("doc"), search.cosine(F.col("q"), F.col("embedding")).alias("cosine"))
    lexical = search.bm25(docs, _queries(spark, folder).where("query_id = 20"))
    return search.hybrid(lexical, dense)


@R.query("hybrid_top50", _HYBRID + "select query, doc, round(hybrid, 6) as hybrid, place from pl where place <= 50")
def hybrid_top50(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder).select("query", "doc", F.round("hybrid", 6).alias("hybrid"), F.col("place").cast("long"))


def _blended(spark: SparkSession, folder: str, candidates: DataFrame) -> DataFrame:
    sizes = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    learned = 1.0 / (1.0 + F.exp(-(F.log1p("n") - 6.0)))
    rows = search.blend(candidates.join(sizes, "doc"), learned=learned, cross=F.col("n") / 1000.0 - 1.0)
    return search.top_k(rows.drop("place"), query="query", doc="doc", score="final", k=10)


@R.query("blend_final", _HYBRID + """, x as (select p.*, 1.0e0 / (1.0e0 + exp(-(ln(1 + coalesce(n_chars, 0)) - 6.0e0))) as learned, coalesce(n_chars, 0) / 1000.0e0 - 1.0e0 as rerank from pl p join documents d on d.doc_id = p.doc where place <= 50),
y as (select doc, 0.25e0 * hybrid + 0.25e0 * learned + 0.5e0 / (1.0e0 + exp(-greatest(-20.0e0, least(20.0e0, case when place <= 20 then rerank else learned end)))) as final from x)
select doc, round(final, 6) as final, rank from (select *, row_number() over (order by round(final, 9) desc, doc) as rank from y) where rank <= 10""")  # fmt: skip
def blend_final(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best of the hybrid candidates after blending with a learned and a cross score; stand-ins made of the length here."""
    return _blended(spark, folder, _hybrid(spark, folder)).select("doc", F.round("final", 6).alias("final"), F.col("place").cast("long").alias("rank"))


_HYBRID_ALL = f"""{_BM25},
v as (select a.vec_id as query, b.vec_id as doc, {_COS} as cosine from embeddings a cross join embeddings b where a.vec_id in (select item_id from eval_items where item_id % 20 = 0) and b.vec_id in (select doc_id from documents)),
mx as (select query, max(bm25) as best from lex group by query),
hy as (select v.query, v.doc, 0.45e0 * coalesce(bm25, 0.0e0) / greatest(1e-6, coalesce(best, 0.0e0)) + 0.55e0 * (cosine + 1.0e0) / 2.0e0 as hybrid from v left join lex on lex.query = v.query and lex.doc = v.doc left join mx on mx.query = v.query),
pl as (select *, row_number() over (partition by query order by round(hybrid, 9) desc, doc) as place from hy)"""


def _hybrid_all(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid search of every item whose id is divisible by 20, with the vector of that id; an item without one fails the query."""
    vectors, docs, items = table(spark, folder, "embeddings"), table(spark, folder, "documents"), _queries(spark, folder)
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = items.select(F.col("query_id").alias("vec_id")).join(vectors, "vec_id", "left")
    lacks = F.raise_error(F.concat(F.lit("no vector for item "), F.col("vec_id")))
    asked = asked.select("vec_id", F.when(F.col("embedding").isNull(), lacks).otherwise(F.col("embedding")).alias("embedding"))
    dense = search.similarities(known, asked, id="vec_id", vector="embedding")
    return search.hybrid(search.bm25(docs, items), dense.select("query", F.col("id").alias("doc"), F.col("similarity").alias("cosine")))


@R.query("hybrid_top50_all", _HYBRID_ALL + "select query, doc, round(hybrid, 6) as hybrid, place from pl where place <= 50")
def hybrid_top50_all(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid_all(spark, folder).select("query", "doc", F.round("hybrid", 6).alias("hybrid"), F.col("place").cast("long"))


@R.query("blend_final_all", _HYBRID_ALL + """, x as (select p.*, 1.0e0 / (1.0e0 + exp(-(ln(1 + coalesce(n_chars, 0)) - 6.0e0))) as learned, coalesce(n_chars, 0) / 1000.0e0 - 1.0e0 as rerank from pl p join documents d on d.doc_id = p.doc where place <= 50),
y as (select query, doc, 0.25e0 * hybrid + 0.25e0 * learned + 0.5e0 / (1.0e0 + exp(-greatest(-20.0e0, least(20.0e0, case when place <= 20 then rerank else learned end)))) as final from x)
select query, doc, round(final, 6) as final, rank from (select *, row_number() over (partition by query order by round(final, 9) desc, doc) as rank from y) where rank <= 10""")  # fmt: skip
def blend_final_all(spark: SparkSession, folder: str) -> DataFrame:
    """blend_final for every item whose id is divisible by 20."""
    return _blended(spark, folder, _hybrid_all(spark, folder)).select("query", "doc", F.round("final", 6).alias("final"), F.col("place").cast("long").alias("rank"))


FTS = 'vector searching or "cache tools" or tooling parsers -notebook'


def _fts_sql() -> str:
    held = lambda side, t: f"len(list_filter(range(1, len({side}) + 1), lambda i: {side}[i:i + len({stems_sql(repr(t.words))}) - 1] = {stems_sql(repr(t.words))})) > 0"
    options = parsed(FTS)
    terms = list({t: None for o in options for t in o})
    hits = ", ".join(f"{held(s, t)} as {s}{i}" for i, t in enumerate(terms) for s in "ab")
    match = " or ".join("(" + " and ".join(("not " if t.excluded else "") + f"(a{terms.index(t)} or b{terms.index(t)})" for t in o) + ")" for o in options)
    rank = " + ".join(f"case when a{i} then 1.0e0 else 0.0e0 end + case when b{i} then 0.4e0 else 0.0e0 end" for i, t in enumerate(terms) if not t.excluded)
    return f"""with u as (select id, any_value(full_name) as full_name, any_value(stars) as stars, any_value(description) as description, any_value(topics) as topics from repositories where not is_archived group by id),
w as (select full_name, stars, {stems_sql("translate(full_name, '/_-', '   ')")} as a, {stems_sql("concat_ws(' ', description, array_to_string(topics, ' '))")} as b from u), h as (select full_name, stars, {hits} from w),
n as (select full_name, any_value(score) as score from leaderboard_items where data_watermark = (select max(data_watermark) from leaderboard_items) group by full_name),
r as (select full_name, stars, 0.55e0 * ({rank}) + 0.45e0 * coalesce(score, 0.0e0) as rank from h left join n using (full_name) where {match})
select full_name, round(rank, 6) as rank from r order by round(r.rank, 9) desc, stars desc, full_name limit 50"""


@R.query("fts_search", _fts_sql())
def fts_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search of repository names, descriptions and topics by stems, with the latest score."""
    rows = leaderboard.current_and_previous(table(spark, folder, "leaderboard_items")).select("full_name", "score")
    found = search.full_text(leaderboard.unique_repositories(table(spark, folder, "repositories")), FTS, scores=rows, limit=50)
    return found.withColumn("rank", F.round("rank", 6))
