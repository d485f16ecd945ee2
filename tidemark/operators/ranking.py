"""Ranks and percentiles over whole tables without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def running_total(df: DataFrame, order: Sequence[Column], amount: Column, name: str) -> DataFrame:
    """Add the sum of `amount` over all rows up to each row in the given order, which must be total.

    Rows are range-partitioned by the order; each range sums its own rows and adds what the ranges before it hold, of which
    there is one number per range.
    """
    ranged = materialize(df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before", "_amount")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "global_rank") -> DataFrame:
    """Add the 1-based place of each row in a total order."""
    return running_total(df, order, F.lit(1).cast("long"), name)


def percentiles(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Add, for each column, a percentile rank in [0, 1] under its new name: the mean 0-based place of all rows of equal value,
    divided by the rows less one. key: a unique column of df.

    A single row has 0.5, nulls count as 0, values are equal if they agree to nine places. Places come from the counts of
    distinct values, so a value that a third of the rows share is one row there; all columns are ranked in one pass.
    """
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)).cast("double"), 9) + F.lit(0.0)
    each = F.array(*[F.struct(F.lit(i).alias("m"), value(c).alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.col(key).alias("_key"), F.explode(each).alias("x")).select("_key", "x.m", "x.v")
    counts = running_total(long.groupBy("m", "v").agg(F.count("*").alias("n")), [F.col("m"), F.col("v")], F.col("n"), "upto")
    whole = counts.groupBy("m").agg(F.sum("n").alias("all"), (F.max("upto") - F.sum("n")).alias("before"))
    place = (2 * (F.col("upto") - F.col("before") - F.col("n")) + F.col("n") - 1) / F.lit(2.0)
    rank = F.when(F.col("all") == 1, 0.5).otherwise(place / F.greatest(F.lit(1), F.col("all") - 1))
    ranks = counts.join(F.broadcast(whole), "m").select("m", "v", rank.alias("rank"))
    wide = long.join(ranks, ["m", "v"]).groupBy("_key").agg(*[F.max(F.when(F.col("m") == i, F.col("rank"))).alias(n) for i, n in enumerate(columns.values())])
    return df.join(wide, F.col(key) == F.col("_key")).drop("_key")
