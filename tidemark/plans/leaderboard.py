"""Queries of growth, percentiles and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import codebase, growth, leaderboard
from tidemark.operators.ranking import percentiles
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()

HISTORY = """
h as (
  select repository_id, observed_at, arg_min(struct_pack(s := stars, f := forks, d := downloads_30d, i := open_issues), id) as r
  from repository_observations where source = 'github' and repository_id is not null and observed_at is not null
    and observed_at >= (select max(observed_at) from repository_observations where source = 'github') - interval 91 day
  group by all)
"""
_GROWTH = (
    HISTORY
    + """,
l as (select repository_id, max(observed_at) as latest_at, min(observed_at) as first_at, count(*) as n from h group by all),
w as (select l.*, unnest([1, 7, 30, 90]) as days from l),
p as (
  select w.*, coalesce((select max(h.observed_at) from h where h.repository_id = w.repository_id and h.observed_at <= w.latest_at - to_days(cast(w.days as integer))
    and h.observed_at < w.latest_at), w.first_at) as then_at from w),
q as (
  select p.*, a.r as a, b.r as b, greatest(1.0e0, (epoch_us(latest_at) - epoch_us(then_at)) / 3.6e9) as hours
  from p join h a on a.repository_id = p.repository_id and a.observed_at = p.latest_at
  join h b on b.repository_id = p.repository_id and b.observed_at = p.then_at),
d as (
  select *, case when n >= 2 then greatest(0, coalesce(a.s, 0) - coalesce(b.s, 0)) else 0 end as ds, case when n >= 2 then greatest(0, coalesce(a.f, 0) - coalesce(b.f, 0)) else 0 end as df,
    case when n >= 2 then greatest(0, coalesce(a.d, 0) - coalesce(b.d, 0)) else 0 end as dd from q),
growth as (
  select repository_id, days, n, a, ds, df, dd, latest_at, case when n >= 2 then (ln(1 + ds * 24 / hours + 2.5e0 * (df * 24 / hours) + dd / 1000.0e0) + 4.0e0 * ds / greatest(25, coalesce(b.s, 0)))
    * (0.35e0 + 0.65e0 * least(1.0e0, hours / (days * 24.0e0))) else 0.0e0 end as growth from d)
"""
)


@R.query("observation_history", "with" + HISTORY + """select r.full_name, strftime(h.observed_at, '%Y-%m-%d %H:%M:%S.%f') as observed_at, cast(h.r.s as bigint) as stars, cast(h.r.f as bigint) as forks
  from h join (select distinct id, full_name from repositories) r on r.id = h.repository_id""")  # fmt: skip
def observation_history(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the last 91 days with their repository."""
    dim = leaderboard.unique_repositories(table(spark, folder, "repositories")).select(F.col("id").alias("repository_id"), "full_name")
    rows = growth.history(table(spark, folder, "repository_observations")).join(dim, "repository_id")
    return rows.select("full_name", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_at"), F.col("stars").cast("long"), F.col("forks").cast("long"))


@R.query("growth_signals", "with" + _GROWTH + "select repository_id, days, cast(ds as bigint) as stars_gain, cast(df as bigint) as forks_gain, cast(dd as bigint) as downloads_gain, round(growth, 6) as growth from growth")
def growth_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Growth over 1, 7, 30 and 90 days, one row for each window."""
    wide = growth.growth(growth.history(table(spark, folder, "repository_observations")))
    each = [
        F.struct(F.lit(w).alias("days"), *[F.col(f"{c}_gain_{w}d").alias(n) for c, n in (("stars", "stars_gain"), ("forks", "forks_gain"), ("downloads_30d", "downloads_gain"))], F.round(f"growth_{w}d", 6).alias("growth"))
        for w in growth.WINDOWS
    ]
    return wide.select("repository_id", F.explode(F.array(*each)).alias("x")).select("repository_id", "x.*")


_PERCENTILE = "case when count(*) over () = 1 then 0.5e0 else ((2 * rank() over (order by {v}) - 2 + count(*) over (partition by {v}) - 1) / 2.0e0) / greatest(1, count(*) over () - 1) end"


@R.query("percentile_ties", f"select repository_id, round({_PERCENTILE.format(v='m')}, 6) as percentile from (select id as repository_id, any_value(forks) as m from repositories group by id)")
def percentile_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of a reading with many ties."""
    rows = leaderboard.unique_repositories(table(spark, folder, "repositories")).select(F.col("id").alias("repository_id"), F.col("forks").cast("double"))
    return percentiles(rows, "repository_id", {"forks": "percentile"}).select("repository_id", F.round("percentile", 6).alias("percentile"))


_LEADERBOARD = (
    "with"
    + _GROWTH
    + f""",
dim as (select id, any_value(full_name) as full_name, any_value(license_spdx) as license_spdx, any_value(is_archived) as is_archived, any_value(github_updated_at) as pushed from repositories group by id),
snaps as (select distinct r.id, s.indexed_commit_sha as sha, s.code_evidence_paths as paths, s.code_chunks as chunks from repository_snapshots s join dim r on r.full_name = s.full_name where s.indexed_commit_sha <> ''),
ev as (select id, count(*) as ev, count(*) filter (where contains(lower(path), 'test')) as tests from (select distinct id, sha, path from (select id, sha, unnest(paths) as path from snaps)) group by id),
vec as (select id, count(*) as vec from (select distinct id, sha, k from (select id, sha, unnest(range(1, len(chunks) + 1)) as k, chunks from snaps) where chunks[k] <> '') group by id),
j as (
  select g.repository_id, dim.*, g.n, max(latest_at) over () as mark, g.latest_at, g.a, growth, days, coalesce(ev.ev, 0) as ev, coalesce(tests, 0) as tests, coalesce(vec.vec, 0) as vec
  from growth g join dim on dim.id = g.repository_id left join ev on ev.id = g.repository_id left join vec on vec.id = g.repository_id),
pct as (select *, case when count(*) over (partition by days) = 1 then 0.5e0 else ((2 * rank() over (partition by days order by round(growth, 9)) - 2 + count(*) over (partition by days, round(growth, 9)) - 1) / 2.0e0)
  / greatest(1, count(*) over (partition by days) - 1) end as pc from j),
wide as (
  select repository_id, any_value(full_name) as full_name, any_value(license_spdx) as lic, any_value(is_archived) as archived, any_value(pushed) as pushed, any_value(n) as n, any_value(mark) as mark, any_value(latest_at) as latest_at,
    any_value(a) as a, any_value(ev) as ev, any_value(tests) as tests, any_value(vec) as vec,
    max(pc) filter (where days = 1) as a1, max(pc) filter (where days = 7) as a7, max(pc) filter (where days = 30) as a30, max(pc) filter (where days = 90) as a90 from pct group by repository_id),
att as (select *, round(ln(1 + coalesce(a.s, 0) + 2.0e0 * coalesce(a.f, 0)), 9) as v from wide),
att2 as (select *, {_PERCENTILE.format(v='v')} as attention from att),
c1 as (
  select *, case when coalesce(lic, '') in ('', 'NOASSERTION', 'OTHER') then 0.0e0 else 1.0e0 end as licensed, case when ev > 0 or vec > 0 then 1.0e0 else 0.0e0 end as code,
    exp(-greatest(0.0e0, (epoch_us(mark) - epoch_us(coalesce(pushed, latest_at))) / 8.64e10) / 75.0e0) as recency from att2),
c2 as (
  select *, greatest(0.0e0, recency * (1.0e0 - 0.35e0 * least(1.0e0, coalesce(a.i, 0) / greatest(25.0e0, coalesce(a.s, 0) * 0.05e0))) * case when archived then 0.0e0 else 1.0e0 end) as maintenance,
    least(1.0e0, 0.2e0 + 0.25e0 * licensed + 0.25e0 * code + 0.3e0 * least(1.0e0, tests / 4.0e0)) as quality,
    least(1.0e0, 0.12e0 + 0.5e0 * (1.0e0 - exp(-vec / 18.0e0)) + 0.38e0 * (1.0e0 - exp(-ev / 8.0e0))) as depth,
    least(1.0e0, 0.3e0 + 0.12e0 * least(3, n) + 0.2e0 * code + 0.1e0 * licensed) as confidence from c1),
c3 as (select *, least(1.0e0, 0.55e0 * (1.0e0 - attention) + 0.45e0 * depth) as originality from c2),
c4 as (select *, (0.025e0 + 0.35e0 * a30 + 0.2e0 * maintenance + 0.15e0 * quality + 0.12e0 * depth + 0.1e0 * originality + 0.03e0 * attention) * (0.8e0 + 0.2e0 * confidence) as score from c3)
select full_name, row_number() over (order by round(score, 9) desc, lower(full_name), repository_id) as global_rank, round(score, 6) as score, round(a1, 6) as adoption_1d, round(a7, 6) as adoption_7d, round(a30, 6) as adoption_30d,
  round(a90, 6) as adoption_90d, round(maintenance, 6) as maintenance_score, round(quality, 6) as quality_score, round(depth, 6) as depth_score, round(originality, 6) as originality_score,
  round(attention, 6) as attention_score, round(confidence, 6) as confidence,
  case when archived or maintenance < 0.24e0 then 'At risk' when a30 >= 0.62e0 and attention < 0.48e0 then 'Hidden gem' when attention >= 0.72e0 and a30 < 0.34e0 then 'Overhyped' when a30 >= 0.58e0 then 'Emerging' else 'Durable' end as label
from c4
"""
)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    repositories = table(spark, folder, "repositories")
    chunks = codebase.indexed_snapshots(table(spark, folder, "repository_snapshots"), repositories)
    return leaderboard.materialized(repositories, table(spark, folder, "repository_observations"), codebase.evidence(chunks), codebase.chunk_counts(chunks))


@R.query("leaderboard_full", _LEADERBOARD)
def leaderboard_full(spark: SparkSession, folder: str) -> DataFrame:
    """The ranked leaderboard with its component scores."""
    rows = _results(spark, folder)
    numbers = ["score", *[f"adoption_{w}d" for w in growth.WINDOWS], *[f"{c}_score" for c in ("maintenance", "quality", "depth", "originality", "attention")], "confidence"]
    return rows.select("full_name", "global_rank", *[F.round(c, 6).alias(c) for c in numbers], "label")


_CTES = _LEADERBOARD[: _LEADERBOARD.rindex("\nselect full_name, row_number()")]
_DELTAS = ", ".join(f"\"{w}\" := struct_pack(stars := s{w}, forks := f{w}, downloads := d{w})" for w in growth.WINDOWS)
_GAINED = ", ".join(f"cast(max({c}) filter (where days = {w}) as bigint) as {n}{w}" for w in growth.WINDOWS for n, c in (("s", "ds"), ("f", "df"), ("d", "dd")))


@R.query(
    "leaderboard_explanations",
    _CTES
    + f""", gained as (select repository_id, {_GAINED} from growth group by 1)
select full_name, cast(to_json(struct_pack(window_deltas := struct_pack({_DELTAS}), observation_count := n, code_evidence := ev, vector_chunks := vec, method := '{leaderboard.FEATURE_VERSION}')) as varchar) as explanation
from c4 join gained using (repository_id)""",
)
def leaderboard_explanations(spark: SparkSession, folder: str) -> DataFrame:
    """Every repository of the leaderboard with the evidence of its score."""
    return _results(spark, folder).select("full_name", "explanation")


def _window_sql(window: int, where: str) -> str:
    return f"""
with lb as ({_LEADERBOARD}), facts as (select id, any_value(full_name) as full_name, any_value(description) as description, any_value(language) as language, any_value(license_spdx) as license, any_value(stars) as stars from repositories where not is_archived group by id),
u as (select full_name, data_watermark, min(item_id) as k from leaderboard_items where data_watermark = (select min(data_watermark) from leaderboard_items) group by all),
prior as (select i.full_name, i.global_rank as prior_rank, i.score as prior_score from leaderboard_items i join u on u.k = i.item_id),
m as (select lb.full_name, coalesce(f.description, '') as description, coalesce(f.language, 'Unknown') as language, coalesce(f.license, 'NOASSERTION') as license, f.stars, score, adoption_{window}d as adoption_score, maintenance_score, quality_score,
  depth_score, originality_score, attention_score, label, global_rank, prior_rank - global_rank as rank_delta, round(score - prior_score, 5) as score_delta from lb join facts f using (full_name) left join prior using (full_name) where {where})
select *, count(*) over () as total_count from m order by adoption_score desc nulls last, full_name limit 25"""


def _window_page(window: int, where: str = "true", **how) -> None:  # noqa: ANN003
    @R.query(f"leaderboard_read_window_{window}", _window_sql(window, where))
    def read(spark: SparkSession, folder: str) -> DataFrame:
        """The first page of the leaderboard by adoption over a window, with movements against the older of the two landed runs."""
        items = table(spark, folder, "leaderboard_items")
        older = items.where(F.col("data_watermark") == items.agg(F.min("data_watermark")).scalar()).groupBy("full_name")
        prior = older.agg(F.min_by(F.struct("global_rank", "score"), "item_id").alias("x")).select("full_name", F.col("x.global_rank").alias("prior_rank"), F.col("x.score").alias("prior_score"))
        scores = ["score", *[f"adoption_{w}d" for w in growth.WINDOWS], *[f"{c}_score" for c in ("maintenance", "quality", "depth", "originality", "attention")]]
        results = _results(spark, folder).withColumns({c: F.round(c, 6) for c in scores})
        rows = leaderboard.window_page(results, prior, table(spark, folder, "repositories"), window=window, sort_by="adoption", **how)
        return rows.withColumn("score_delta", F.round("score_delta", 5))


_window_page(1)
_window_page(7, "lower(f.language) = 'python'", language="python")
_window_page(90)


_RUNS = "select distinct data_watermark from leaderboard_items"


@R.query(
    "snapshot_header",
    f"""with r as ({_RUNS}), h as (
  select '{leaderboard.FEATURE_VERSION}' as feature_version, data_watermark, case when data_watermark = (select max(data_watermark) from r) then 'linear-2' else 'linear-1' end as model_version, data_watermark + interval 1 hour as created_at from r)
select feature_version, strftime(data_watermark, '%Y-%m-%d %H:%M:%S') as data_watermark, model_version, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, row_number() over (order by data_watermark desc) as recency from h""",
)
def snapshot_header(spark: SparkSession, folder: str) -> DataFrame:
    """The runs that landed, the latest of them written again by another model, and a run of other features: those of the first, by recency."""
    runs = table(spark, folder, "leaderboard_items").select("data_watermark").distinct()
    last = runs.agg(F.max("data_watermark")).scalar()
    header = lambda rows, features, model, hours: rows.select(F.lit(features).alias("feature_version"), "data_watermark", F.lit(model).alias("model_version"), (F.col("data_watermark") + F.expr(f"interval {hours} hours")).alias("created_at"))
    headers = header(runs, leaderboard.FEATURE_VERSION, "linear-1", 1).unionByName(header(runs, "leaderboard-v0", "linear-0", 0))
    headers = leaderboard.add_headers(headers, header(runs.where(F.col("data_watermark") == last), leaderboard.FEATURE_VERSION, "linear-2", 9))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("data_watermark", "created_at")]
    return leaderboard.run_recency(headers).select("feature_version", shown[0], "model_version", shown[1], F.col("recency").cast("long"))


def _page_sql(where: str, order: str, limit: int, offset: int) -> str:
    return f"""
with u as (select full_name, data_watermark, any_value(item_id) as k from leaderboard_items group by all),
i as (select x.* from leaderboard_items x join u on u.k = x.item_id),
w as (select data_watermark, row_number() over (order by data_watermark desc) as recency from (select distinct data_watermark from leaderboard_items)),
n as (select i.* from i join w using (data_watermark) where recency = 1), t as (select i.* from i join w using (data_watermark) where recency = 2),
m as (
  select n.full_name, coalesce(n.description, '') as description, coalesce(n.language, 'Unknown') as language, coalesce(n.license, 'NOASSERTION') as license, n.stars, n.score, n.adoption_score, n.maintenance_score,
    n.quality_score, n.depth_score, n.originality_score, n.attention_score, n.status as label, n.global_rank, t.global_rank - n.global_rank as rank_delta, n.score - t.score as score_delta
  from n left join t using (full_name) where {where}),
c as (select *, count(*) over () as total_count from m order by {order} limit {limit} offset {offset})
select * exclude (score_delta), round(score_delta, 6) as score_delta from c"""


def _page(name: str, where: str, order: str, limit: int = 25, offset: int = 0, **how) -> None:  # noqa: ANN003
    @R.query(name, _page_sql(where, order, limit, offset))
    def read(spark: SparkSession, folder: str) -> DataFrame:
        rows = leaderboard.page(table(spark, folder, "leaderboard_items"), limit=limit, offset=offset, **how)
        return rows.withColumn("score_delta", F.round("score_delta", 6))


_page("leaderboard_read_overall", "true", "score desc nulls last, full_name")
_page("leaderboard_read_adoption", "true", "adoption_score desc nulls last, full_name", sort_by="adoption")
_page("leaderboard_read_momentum", "true", "rank_delta desc nulls last, full_name", sort_by="momentum")
_page("leaderboard_read_stars", "true", "stars desc nulls last, full_name", limit=100, sort_by="stars")
_page("leaderboard_read_filtered", "lower(n.language) = 'python' and lower(n.status) = 'emerging'", "score desc nulls last, full_name", language=" Python ", label="Emerging", owner="  ")
_page("leaderboard_read_page2", "lower(n.language) = 'python'", "full_name", limit=25, offset=25, language="python", sort_by=None)


@R.query("facets_language", "select distinct language as value from repositories where not is_archived and language is not null order by 1 limit 100")
def facets_language(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.facet(table(spark, folder, "repositories"), "language")


@R.query("facets_license", "select distinct license_spdx as value from repositories where not is_archived and license_spdx is not null order by 1 limit 100")
def facets_license(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.facet(table(spark, folder, "repositories"), "license_spdx")


_ZEROED = ["score", "confidence", "adoption_score", "maintenance_score", "quality_score", "depth_score", "originality_score", "attention_score"]


@R.query(
    "leaderboard_body",
    """select item_id, full_name as "fullName", owner, name, coalesce(description, '') as description, coalesce(language, 'Unknown') as language, coalesce(license, 'NOASSERTION') as license,
      coalesce(stars, 0) as stars, coalesce(forks, 0) as forks, coalesce(global_rank, 0) as "globalRank", rank_delta as "rankDelta", round(score_delta, 6) as "scoreDelta", """
    + ", ".join(f'round(coalesce({c}, 0), 6) as "{leaderboard.camel(c)}"' for c in _ZEROED)
    + " from leaderboard_items",
)
def leaderboard_body(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaderboard item as the fields of a response."""
    body = leaderboard.response_body(table(spark, folder, "leaderboard_items"))
    return body.withColumns({c: F.round(c, 6) for c in [*map(leaderboard.camel, _ZEROED), "scoreDelta"]})
