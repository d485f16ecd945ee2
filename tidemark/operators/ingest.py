"""Idempotent ingest: deduplication, upserts, inserts, updates, retention and compaction, as plans over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, *, key: Column, at: str, order: str, first_on_ties: bool) -> DataFrame:
    """The latest row of each key; of rows of one instant the first or the last by `order` (unique). All columns stay."""
    tie = F.col(order).asc() if first_on_ties else F.col(order).desc()
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The table after an upsert: matched rows take the `update` columns of `new`, others stay, unknown keys come in whole.

    Both sides must be unique by key. Columns that `new` lacks are null in the rows it adds.
    """
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_new"))
    both = o.join(n, list(keys), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_old.{c}")
        if c in update:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))

    return both.select(*keys, *[value(c).alias(c) for c in rest])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], *, order: str) -> DataFrame:
    """The table after inserting the rows of `new` whose keys it lacks; of several new rows of one key the first by `order` comes in.

    Keys with a null are never equal to another, as in SQL, so such rows all come in.
    """
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    first = Window.partitionBy(*keys).orderBy(order)
    once = new.where(full).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return old.unionByName(once.join(old.select(*keys), list(keys), "left_anti")).unionByName(new.where(~full))


def update_matched(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The table after setting the `update` columns of rows whose key `new` has (unique there); no row is added."""
    n = new.select(*keys, F.struct(*update).alias("_new"))
    rows = old.join(n, list(keys), "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in update else c for c in old.columns])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write df so that the partitions it holds replace those on disk; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def keep_recent(df: DataFrame, *, at: str, days: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Rows of the last `days` before `as_of`, or before the table's latest instant if that isn't given; rows without an instant go."""
    return df.where(F.col(at) >= _now(df, at, as_of) - F.expr(f"interval {days} days"))


def _now(df: DataFrame, at: str, as_of: datetime | None) -> Column:
    return df.agg(F.max(at)).scalar() if as_of is None else F.lit(as_of).cast(df.schema[at].dataType)


def compact(df: DataFrame, keys: Sequence[str], *, at: str, order: str, young: int = 30, old: int = 90, as_of: datetime | None = None) -> DataFrame:
    """Of rows between `young` and `old` days before `as_of` (the table's latest instant if that isn't given) only the last of each key and day; all others stay.

    The window runs within a key and day, so a hot key is spread over its days.
    """
    now = _now(df, at, as_of)
    between = (F.col(at) < now - F.expr(f"interval {young} days")) & (F.col(at) >= now - F.expr(f"interval {old} days"))
    w = Window.partitionBy(*keys, F.to_date(at)).orderBy(F.col(at).desc(), F.col(order).desc())
    kept = df.where(between).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return df.where(~F.coalesce(between, F.lit(False))).unionByName(kept)


def missing_from_cache(texts: DataFrame, cache: DataFrame, *, digest: str) -> DataFrame:
    """The distinct digests that a cache lacks: what is left to encode."""
    return texts.select(digest).distinct().join(cache.select(digest), digest, "left_anti")
