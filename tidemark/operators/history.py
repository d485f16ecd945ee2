"""Type-two history of changing attributes, built or extended from captures."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def _hash(attrs: list[str]) -> Column:
    """A digest of the attribute values; each is preceded by its length, so no two lists of values are written alike."""
    parts: list[Column] = []
    for a in attrs:
        s = F.col(a).cast("string")
        parts += [F.coalesce(F.length(s).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(s, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def captures(df: DataFrame, *, key: Column, at: str, order: str, attributes: Mapping[str, Column], only: DataFrame | None = None) -> DataFrame:
    """(key, at, attributes..., digest): one row per key and instant, of several the one with the largest `order`.

    Captures without key or instant are left out: they belong to no history. only: (key) the keys to take, all if not given;
    others are left out before the shuffle where the keys are few enough for Spark to broadcast.
    """
    attrs = list(attributes)
    rows = df.select(key.alias("key"), F.col(at).alias("at"), F.col(order).alias("ord"), F.struct(*[c.alias(a) for a, c in attributes.items()]).alias("a"))
    rows = rows.where("key is not null and at is not null")
    rows = rows if only is None else rows.join(only, "key", "left_semi")
    rows = rows.groupBy("key", "at").agg(F.max(F.struct("ord", "a")).alias("x"))
    return rows.select("key", "at", "x.a.*").withColumn("digest", _hash(attrs))


def _compared(rows: DataFrame, over: list[str]) -> DataFrame:
    """Add `new`: whether a capture differs from the one before, and `newest`: whether none follows."""
    w = Window.partitionBy(*over).orderBy("at")
    return rows.withColumn("new", F.coalesce(F.lag("digest").over(w) != F.col("digest"), F.lit(True))).withColumn("newest", F.lead("at").over(w).isNull())


def build_history(rows: DataFrame, *, slice_unit: str = "month") -> DataFrame:
    """Versions (key, valid_from, valid_to, is_current, seen_at, attributes..., digest) of captures.

    Each version runs from the first capture that shows it to the first that differs; values that return start anew. While it
    is open, valid_to is null and seen_at is the key's last capture; in closed versions seen_at is null.

    A hot key is compared slice by slice (key and month) first; only the changes within the slices and their last captures meet
    in the key's own window, so its size follows the number of versions and slices, not of captures.
    """
    inside = _compared(rows.withColumn("slice", F.date_trunc(slice_unit, F.col("at").cast("timestamp"))), ["key", "slice"]).where("new or newest").drop("slice")
    w = Window.partitionBy("key").orderBy("at")
    v = _compared(inside, ["key"]).withColumn("seen", F.max("at").over(Window.partitionBy("key"))).where("new").withColumn("valid_to", F.lead("at").over(w))
    rest = [c for c in rows.columns if c not in ("key", "at", "digest")]
    open_ = F.col("valid_to").isNull()
    return v.select("key", F.col("at").alias("valid_from"), "valid_to", open_.alias("is_current"), F.when(open_, F.col("seen")).alias("seen_at"), *rest, "digest")


def merge_history(history: DataFrame, batch: DataFrame, *, log: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Merge a batch of captures into a history: close changed versions, insert new open ones, keep the rest.

    The batch's captures are compared by digest with the open version of their key: where none differs, only its seen_at moves;
    otherwise the open version ends at the first capture that differs, and the batch's versions are inserted behind it. Keys
    that history doesn't have come in new. Closed versions stay as they are.

    Late captures: a key with a capture in the batch that isn't newer than all seen before (an earlier instant, or the same one
    delivered again) can't be merged into versions alone. Such keys are taken out and built anew from `log`, which
    gives all captures so far of the keys it gets, those of the batch included. Without a log the query fails on them.
    """
    rest = [c for c in history.columns if c not in ("key", "valid_from", "valid_to", "is_current", "seen_at", "digest")]
    current, closed = history.where("is_current"), history.where("not is_current")
    oldest = batch.groupBy("key").agg(F.min("at").alias("oldest"))
    late = materialize(current.select("key", "seen_at").join(oldest, "key").where("oldest <= seen_at").select("key"), "late")
    if log is None and not late.isEmpty():
        raise ValueError("the batch holds late captures, which need the log")
    now = current.select("key", F.col("valid_from").alias("at"), *rest, "digest")
    seen = current.where("seen_at > valid_from").select("key", F.col("seen_at").alias("at"), *rest, "digest")  # the same version, as it was last seen
    rows = now.unionByName(seen).unionByName(batch.select(*now.columns)).join(late, "key", "left_anti")
    if log is not None:
        rows = rows.unionByName(log(late).select(*now.columns))
    return closed.join(late, "key", "left_anti").select(*history.columns).unionByName(build_history(rows).select(*history.columns))


def history_by_batches(rows: DataFrame, *, batch: Column, take: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """The history of rows that arrive in batches: each batch is merged into the table that the merges before it wrote.

    batch: the batch of a row, in the order of arrival, null the first; there should be few (months, say), as each is a merge
    of its own and its number is known to the driver. take: turns rows into captures, of the given keys only if any
    are given.
    """
    rows = rows.withColumn("_batch", batch)
    numbers = [r[0] for r in rows.select("_batch").distinct().orderBy(F.col("_batch").asc_nulls_first()).collect()]
    history = build_history(take(rows.limit(0), None))
    for n in numbers:
        so_far = F.col("_batch").isNull() if n is None else F.col("_batch").isNull() | (F.col("_batch") <= F.lit(n))
        batch_rows = take(rows.where(F.col("_batch").eqNullSafe(F.lit(n))), None)
        merged = merge_history(history, batch_rows, log=lambda keys, seen=rows.where(so_far): take(seen, keys))
        history = materialize(merged, "history")
    return history
