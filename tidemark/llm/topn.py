"""The N best items of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, *, key: str, version: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, that of the largest `version` columns; combined before the shuffle, so repeated deliveries cost little."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*version)).alias("x"))
    return rows.select(F.col(key), "x.*")


def top_n(df: DataFrame, *, groups: Sequence[Column], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, with their place as `place`.

    Written as row_number and a filter on it, which Spark turns into a group limit before and after the shuffle: at most n
    rows of a group leave a task, so a group of millions of rows is no hot spot. The order must be total over the group's
    distinct rows for the result to be defined; null order values go where the columns' own null rules put them.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_repositories(items: DataFrame, *, n: int = 3) -> DataFrame:
    """For every owner and language, regardless of case, the n repositories of the highest score: (owner, language, full_name, place).

    Each full_name counts once, with its row of the latest data_watermark. Equal scores are settled by global_rank (nulls
    last), then by full_name. Null scores are 0, a null language is `Unknown`; rows without full_name are left out; a null
    owner forms a group of its own. An empty table gives an empty result.
    """
    rows = items.select("full_name", "owner", "language", "score", "global_rank", "data_watermark", "item_id")
    rows = latest_rows(rows, key="full_name", version=["data_watermark", "item_id"], keep=["owner", "language", "score", "global_rank"])
    rows = rows.select(
        F.lower("owner").alias("owner"),
        F.lower(F.coalesce("language", F.lit("Unknown"))).alias("language"),
        "full_name",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "global_rank",
    )
    order = [F.col("score").desc(), F.col("global_rank").asc_nulls_last(), F.col("full_name").asc()]
    best = top_n(rows, groups=[F.col("owner"), F.col("language")], order=order, n=n)
    return best.select("owner", "language", "full_name", "place")
