"""Landed JSON lines and text files: snapshots, pairs, seed queries, raw search results, earlier outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schemas import PAIR, RAW_ITEM, SNAPSHOT, with_defaults


def read_snapshots(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Snapshots of all paths with defaults for missing fields; blank lines and unknown fields are skipped, broken lines fail."""
    return with_defaults(spark.read.schema(SNAPSHOT).option("mode", "FAILFAST").json(list(paths)))


def write_lines(df: DataFrame, path: str, *, sort: str | None = "full_name") -> None:
    """Write JSON lines, range-partitioned and sorted by a name regardless of case, so the parts in order are sorted as a whole."""
    rows = df if sort is None else df.repartitionByRange(F.lower(sort)).sortWithinPartitions(F.lower(sort))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("mode", "FAILFAST").json(path)


def read_seed_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query): the trimmed lines of a text file that aren't blank and don't begin with `#`."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(F.trim("value").alias("query")).where("query <> ''")


def first_filled(*columns: str, default: int = 0):  # noqa: ANN201
    """The first of the columns that is neither null nor 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in columns], F.lit(default))


def hydrated(raw: DataFrame) -> DataFrame:
    """Raw search results as snapshot fields, with what counts as missing replaced."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return raw.select(
        "full_name", text("description", "").alias("description"), text("language", "Unknown").alias("language"), text("license_spdx", "NOASSERTION").alias("license_spdx"),
        first_filled("watchers", "stars").alias("watchers"), F.coalesce("archived", F.lit(False)).alias("archived"),
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw search results, one JSON object a line."""
    return spark.read.schema(RAW_ITEM).option("mode", "FAILFAST").json(path)


def hydrated_items(raw: DataFrame, *, captured_at: Column, source_query: str) -> DataFrame:
    """Raw search results as snapshots: every field of theirs under its name there, with what counts as missing replaced; 0, '' and an
    empty list do, so a count of 0 subscribers gives way to that of watchers. What other requests tell (releases, packages) is null."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c.split(".")[-1])
    counts = {"stars": "stargazers_count", "forks": "forks_count", "open_issues": "open_issues_count", "size_kb": "size"}
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return raw.select(
        "full_name", "html_url", captured_at.alias("captured_at"), text("description", ""), text("language", "Unknown"), text("license.spdx_id", "NOASSERTION").alias("license_spdx"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), *[first_filled(c).alias(n) for n, c in counts.items()], first_filled("subscribers_count", "watchers_count").alias("watchers"),
        flag("archived"), flag("fork"), "pushed_at", "created_at", F.lit(source_query).alias("source_query"),
    )


def package_names(names: DataFrame, packages: DataFrame) -> DataFrame:
    """(name, package): for each name the first of itself, with `-` for `_`, with `_` for `-`, that is a known package."""
    n = F.col("name")
    tries = F.array_distinct(F.array(n, F.replace(n, F.lit("_"), F.lit("-")), F.replace(n, F.lit("-"), F.lit("_"))))
    rows = names.select("name").distinct().select("name", F.posexplode(tries).alias("pos", "package"))
    return rows.join(packages.select("package").distinct(), "package").groupBy("name").agg(F.min_by("package", "pos").alias("package"))


def with_previous(rows: DataFrame, previous: DataFrame, *, fields: Sequence[str], order: str, missing: str) -> DataFrame:
    """Rows whose `missing` field is null get `fields` from the latest earlier output of their exact full_name; others and unknown ones stay."""
    last = Window.partitionBy("full_name").orderBy(F.col(order).desc())
    old = previous.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("full_name", F.struct(*fields).alias("_old"))
    joined = rows.join(old, "full_name", "left")
    take = F.col(missing).isNull() & F.col("_old").isNotNull()
    return joined.select(*[F.when(take, F.col(f"_old.{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in rows.columns])
