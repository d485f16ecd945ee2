"""Queries of the rolling totals and of the attribute history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, rolling
from tidemark.plans.registry import Registry
from tidemark.session import CO_PARTITION
from tidemark.sources.tables import table

R = Registry()

_ROLLING_SQL = """
with once as (
  select repository_id, observed_at, arg_min(struct_pack(s := stars, f := forks, d := downloads_30d), id) as v
  from repository_observations where source = 'github' and repository_id is not null and observed_at is not null
  group by all),
long as (
  select repository_id, cast(observed_at as date) as day, observed_at, m.metric, m.value
  from (select repository_id, observed_at, unnest([
    struct_pack(metric := 'stars', value := cast(v.s as bigint)), struct_pack(metric := 'forks', value := cast(v.f as bigint)),
    struct_pack(metric := 'downloads_30d', value := cast(v.d as bigint))]) as m from once)),
daily as (
  select repository_id, metric, day, arg_max(value, observed_at) as value from long where value is not null group by all),
gains as (
  select repository_id, metric, day, value - lag(value) over (partition by repository_id, metric order by day) as gain from daily),
bounds as (
  select repository_id, min(cast(observed_at as date)) as first_day, max(cast(observed_at as date)) as last_day from once group by all),
calendar as (
  select repository_id, first_day, cast(unnest(generate_series(first_day, last_day, interval 1 day)) as date) as day from bounds),
grid as (
  select c.*, m.metric, coalesce(g.gain, 0) as gain
  from calendar c cross join (values ('stars'), ('forks'), ('downloads_30d')) m(metric)
  left join gains g on g.repository_id = c.repository_id and g.day = c.day and g.metric = m.metric),
totals as (
  select repository_id, first_day, day, metric,
    cast(sum(gain) over (w rows between 6 preceding and current row) as bigint) as total_7,
    cast(sum(gain) over (w rows between 29 preceding and current row) as bigint) as total_30
  from grid window w as (partition by repository_id, metric order by day))
"""


def rolling_github(spark: SparkSession, folder: str) -> DataFrame:
    """The rolling gains of the github rows; until the next query is set up, joins may use a split by some of their keys."""
    spark.conf.set(CO_PARTITION, "false")
    return rolling.rolling_gains(table(spark, folder, "repository_observations").where("source = 'github'"))


@R.query(
    "p2_found",
    _ROLLING_SQL + "select repository_id, strftime(day, '%Y-%m-%d') as day, metric from totals where total_7 = 0 and total_30 <> 0",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories, days and metrics that gained nothing over 7 days, but something over 30."""
    rows = rolling_github(spark, folder).where("total_7 = 0 and total_30 <> 0")
    return rows.select("repository_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "metric")


@R.query(
    "p2_rolling",
    _ROLLING_SQL
    + """select repository_id, strftime(day, '%Y-%m-%d') as day, metric, total_7, total_30,
      round(total_7 / least(7, date_diff('day', first_day, day) + 1)::double, 6) as average_7,
      round(total_30 / least(30, date_diff('day', first_day, day) + 1)::double, 6) as average_30 from totals""",
)
def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Every repository, day and metric with its totals and daily averages over the trailing 7 and 30 days."""
    rows = rolling_github(spark, folder)
    averages = [F.round(f"average_{p}", 6).alias(f"average_{p}") for p in (7, 30)]
    return rows.select("repository_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "metric", "total_7", "total_30", *averages)


_VERSIONS_SQL = """
with once as (
  select lower(full_name) as full_name, captured_at,
    arg_max(struct_pack(l := coalesce(license_spdx, 'NOASSERTION'), a := coalesce(archived, false), d := coalesce(description, '')), snapshot_id) as v
  from repository_snapshots where full_name is not null and captured_at is not null group by 1, 2),
marked as (select *, lag(v) over (partition by full_name order by captured_at) as was from once),
versions as (select *, lead(captured_at) over (partition by full_name order by captured_at) as ended from marked where was is null or was <> v)
"""
_TIME = "yyyy-MM-dd HH:mm:ss"


def snapshot_captures(df: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Captures of license, archived flag and description; repositories are equal regardless of case, nulls are the schema's defaults."""
    attributes = {
        "license_spdx": F.coalesce("license_spdx", F.lit("NOASSERTION")),
        "archived": F.coalesce("archived", F.lit(False)),
        "description": F.coalesce("description", F.lit("")),
    }
    return history.captures(df, key=F.lower("full_name"), at="captured_at", order="snapshot_id", attributes=attributes, only=only)


def merged_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The history of the snapshots as they landed, one merge for each month of landing; late captures rebuild their repository."""
    rows = table(spark, folder, "repository_snapshots").select("full_name", "captured_at", "snapshot_id", "license_spdx", "archived", "description", "landed_at")
    return history.history_by_batches(rows, batch=F.date_format("landed_at", "yyyy-MM"), take=snapshot_captures)


@R.query("p4_found", _VERSIONS_SQL + "select full_name, strftime(captured_at, '%Y-%m-%d %H:%M:%S') as valid_from from versions")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of a repository's license, archived flag and description, with its first capture."""
    return merged_snapshots(spark, folder).select(F.col("key").alias("full_name"), F.date_format("valid_from", _TIME).alias("valid_from"))


_P4_FULL = """select full_name, strftime(captured_at, '%Y-%m-%d %H:%M:%S') as valid_from, strftime(ended, '%Y-%m-%d %H:%M:%S') as valid_to,
  v.l as license_spdx, v.a as archived, v.d as description from versions"""


def _show(versions: DataFrame) -> DataFrame:
    times = [F.date_format(c, _TIME).alias(c) for c in ("valid_from", "valid_to")]
    return versions.select(F.col("key").alias("full_name"), *times, "license_spdx", "archived", "description")


@R.query("p4_history", _VERSIONS_SQL + _P4_FULL)
def p4_history(spark: SparkSession, folder: str) -> DataFrame:
    """The full history, with the values and the end of each version."""
    return _show(merged_snapshots(spark, folder))


@R.query("p4_merge", _VERSIONS_SQL + _P4_FULL)
def p4_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The same history by one merge: what landed until 1 March 2026 built at once, what landed later as a batch into it."""
    rows = table(spark, folder, "repository_snapshots")
    early = F.coalesce(F.col("landed_at") < F.lit("2026-03-01").cast("timestamp_ntz"), F.lit(True))
    first = history.build_history(snapshot_captures(rows.where(early)))
    return _show(history.merge_history(first, snapshot_captures(rows.where(~early)), log=lambda keys: snapshot_captures(rows, keys)))
