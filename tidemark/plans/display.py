"""Queries of what is shown: labels, lines, pages, merged lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import display as d
from tidemark.functions import text
from tidemark.operators import leaderboard
from tidemark.operators.ranking import global_rank
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()
QUERY = "Vector search, cache or CLI tooling"

_MATCH = "cast(floor(70.0e0 + 29.0e0 / (1.0e0 + exp(-score)) + 0.5e0) as bigint)"
_P = "greatest(0.0e0, least(1.0e0, score))"
_PERCENT = "cast(floor(greatest(0.0e0, least(1.0e0, {})) * 100.0e0 + 0.5e0) as bigint)"


def _unit(power: int, name: str) -> str:
    tenths = f"cast(floor(stars / 1e{power - 1} + 0.5e0) as bigint)"
    return f"({tenths} // 10) || case when {tenths} % 10 = 0 then '' else '.' || ({tenths} % 10) end || '{name}'"


@R.query(
    "ui_labels",
    f"""select item_id, case when score is null then 'Unscored' when {_P} >= 0.7e0 then 'Emerging' when {_P} >= 0.5e0 then 'Durable' else 'Hidden gem' end as label, cast(floor(80.0e0 + 20.0e0 * coalesce(case when score is null then null else {_P} end, 0.5e0) + 0.5e0) as bigint) as tail,
  {_MATCH} as match, case when {_MATCH} >= 90 then 'Strong' when {_MATCH} >= 80 then 'Good' else 'Partial' end as bucket, {_PERCENT.format('attention_score')} as attention, {_PERCENT.format('(maintenance_score + quality_score) / 2.0e0')} as health,
  case when rank_delta is null then 'new' when rank_delta > 0 then '↑ ' || rank_delta when rank_delta < 0 then '↓ ' || abs(rank_delta) else '—' end as movement,
  case when stars < 10000 then format('{{:,}}', stars) when stars < 999950 then {_unit(3, 'K')} when stars < 999950000 then {_unit(6, 'M')} else {_unit(9, 'B')} end as stars_shown from leaderboard_items""",
)
def ui_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, percentages, movements and short numbers of every item; its score stands for a probability."""
    c = F.col
    match = d.match_score(c("score"))
    return table(spark, folder, "leaderboard_items").select(
        "item_id", d.adoption_label(c("score")).alias("label"), d.spark_tail(c("score")).alias("tail"), match.alias("match"), d.compare_bucket(match).alias("bucket"), d.percent(c("attention_score")).alias("attention"),
        d.percent((c("maintenance_score") + c("quality_score")) / 2.0).alias("health"), d.movement(c("rank_delta"), " ").alias("movement"), d.compact_number(c("stars")).alias("stars_shown"),
    )


@R.query(
    "result_lines",
    """select item_id, case when length(cast(global_rank as varchar)) < 4 then lpad(cast(global_rank as varchar), 4, '0') else cast(global_rank as varchar) end || ' ' || full_name || '  ' || printf('%5.1f', round(score, 2) * 100.0e0) || '  ' || status || '  '
  || case when rank_delta is null then 'new' when rank_delta > 0 then '↑' || rank_delta when rank_delta < 0 then '↓' || abs(rank_delta) else '—' end || chr(10) || '     ' || url as line from leaderboard_items""",
)
def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every item as the lines of a text output; without a score, rank or status there are none."""
    rows = table(spark, folder, "leaderboard_items").withColumn("score", F.round("score", 2))
    return rows.select("item_id", d.result_line("global_rank", "full_name", "score", "status", "rank_delta", "url").alias("line"))


_PREVIEW = f"""w as (select list_filter(regexp_split_to_array(lower('{QUERY}'), '\\W+'), lambda x: length(x) > 2) as w),
pv as (select *, least(99, cast(floor(match - 5 + len(list_filter(w, lambda x: contains(lower(array_to_string(list_concat(topics, [name, coalesce(description, '')]), ' ')), x))) / greatest(1, len(w))::double * 14.0e0 + 0.5e0) as bigint)) as preview
  from (select *, {_MATCH} as match from leaderboard_items), w)"""


def _preview(items: DataFrame) -> DataFrame:
    texts = [F.array_join("topics", " "), F.col("name"), F.coalesce("description", F.lit(""))]
    return items.withColumn("preview", d.preview_score(d.match_score(F.col("score")), texts, QUERY))


@R.query("preview_scores", f"with {_PREVIEW} select item_id, preview from pv")
def preview_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _preview(table(spark, folder, "leaderboard_items")).select("item_id", "preview")


@R.query("preview_top4", f"with {_PREVIEW} select item_id, preview from pv order by preview desc nulls last, item_id limit 4")
def preview_top4(spark: SparkSession, folder: str) -> DataFrame:
    """The four items that a preview shows."""
    return preview_scores(spark, folder).orderBy(F.col("preview").desc_nulls_last(), "item_id").limit(4)


@R.query("page_numbers", "select coalesce(language, 'Unknown') as language, count(*) as total, greatest(1, cast(ceil(count(*) / 25.0e0) as bigint)) as total_pages from leaderboard_items group by 1")
def page_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of 25 items of each language."""
    rows = table(spark, folder, "leaderboard_items").groupBy(F.coalesce("language", F.lit("Unknown")).alias("language")).agg(F.count("*").alias("total"))
    return rows.withColumn("total_pages", d.total_pages(F.col("total"), 25).cast("long"))


_NOW = "n as (select full_name, any_value(score) as score, any_value(data_watermark) as mark from leaderboard_items where data_watermark = (select max(data_watermark) from leaderboard_items) group by full_name)"


@R.query("result_ids", f"with {_NOW}, t as (select * from n order by score desc nulls last, full_name limit 25) select string_agg(full_name, ' ' order by score desc nulls last, full_name) as ids, strftime(max(mark), '%Y-%m-%d') as watermark from t")
def result_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the first page in their order, and the watermark of its data."""
    rows = leaderboard.current_and_previous(table(spark, folder, "leaderboard_items")).select("full_name", "score", "data_watermark")
    first = rows.orderBy(F.col("score").desc_nulls_last(), "full_name").limit(25)
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("s"), "full_name")
    listed = first.agg(F.array_sort(F.collect_list(order)).alias("x"), F.max("data_watermark").alias("mark"))
    return listed.select(F.array_join(F.transform("x", lambda x: x["full_name"]), " ").alias("ids"), F.date_format("mark", "yyyy-MM-dd").alias("watermark"))


@R.query(
    "merged_list",
    f"""with {_NOW}, t as (select full_name, row_number() over (order by score desc nulls last, full_name) as pos from n), s as (select distinct full_name, stars from repositories),
m as (select full_name, 'live' as origin, pos, 0 as stars from t where pos <= 25 union all select full_name, 'known', null, stars from s where lower(full_name) not in (select lower(full_name) from t where pos <= 25))
select full_name, origin, row_number() over (order by coalesce(pos, 10000), stars desc, full_name) as place from m""",
)
def merged_list(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of live results in its order, then the known repositories that aren't among them, by stars."""
    now = leaderboard.current_and_previous(table(spark, folder, "leaderboard_items")).select("full_name", "score")
    live = global_rank(now.orderBy(F.col("score").desc_nulls_last(), "full_name").limit(25), [F.col("score").desc_nulls_last(), F.col("full_name").asc()], "pos")
    live = live.select("full_name", F.lit("live").alias("origin"), "pos", F.lit(0).alias("stars"))
    known = table(spark, folder, "repositories").select("full_name", "stars").distinct()
    rest = known.withColumn("key", F.lower("full_name")).join(live.select(F.lower("full_name").alias("key")), "key", "left_anti")
    rows = live.unionByName(rest.select("full_name", F.lit("known").alias("origin"), F.lit(None).cast("long").alias("pos"), "stars"))
    order = [F.coalesce("pos", F.lit(10_000)).asc(), F.col("stars").desc(), F.col("full_name").asc()]
    return global_rank(rows, order, "place").select("full_name", "origin", "place")


@R.query(
    "reasons",
    """select snapshot_id, case when len(topics) > 0 then 'implements ' || array_to_string(topics[1:2], ', ') else 'source-level capability match' end
  || case when len(code_evidence_paths) > 0 then '; verified in ' || array_to_string(code_evidence_paths[1:2], ', ') else '' end as reason from repository_snapshots""",
)
def reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why each snapshot would be shown."""
    return table(spark, folder, "repository_snapshots").select("snapshot_id", text.reason().alias("reason"))
