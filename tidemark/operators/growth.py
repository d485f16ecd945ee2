"""Growth of a repository's readings over look-back windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WINDOWS = (1, 7, 30, 90)
_READINGS = ("stars", "forks", "downloads_30d", "open_issues")


def history(observations: DataFrame, *, source: str = "github", days: int = 91) -> DataFrame:
    """The source's readings of the last `days` before its latest one, once per repository and instant (the first arrival stands).

    The latest instant is a scalar subquery, so the scan can skip what is older; the result is written, as growth reads it twice.
    """
    rows = observations.where((F.col("source") == source) & F.col("repository_id").isNotNull() & F.col("observed_at").isNotNull())
    last = rows.agg(F.max("observed_at")).scalar()
    recent = rows.where(F.col("observed_at") >= last - F.expr(f"interval {days} days"))
    return materialize(recent.groupBy("repository_id", "observed_at").agg(*[F.min_by(c, "id").alias(c) for c in _READINGS]), "history")


def hours_between(a: Column, b: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(3.6e9)


def growth(rows: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """One row per repository with its latest reading and, per window, deltas and the growth signal.

    A window compares the latest reading with the last one at or before its start, or the earliest there is. Fewer than two
    readings give zeros. Null readings count as 0, falling ones as no change. All windows come from one aggregation with
    partial sums, so repositories with very many readings are combined before the shuffle.
    """
    at = F.col("observed_at")
    reading = F.struct("observed_at", *_READINGS)
    latest = rows.groupBy("repository_id").agg(F.max("observed_at").alias("latest_at"))
    both = rows.join(latest, "repository_id")
    start = lambda w: F.col("latest_at") - F.expr(f"interval {w} days")
    one = both.groupBy("repository_id").agg(
        F.count("*").alias("observations"),
        F.max_by(reading, at).alias("now"),
        F.min_by(reading, at).alias("first"),
        *[F.max_by(reading, F.when((at <= start(w)) & (at < F.col("latest_at")), at)).alias(f"at_{w}") for w in windows],
    )
    out = one.select("repository_id", "observations", "now", *[c for w in windows for c in _signal(w)])
    return out


def _signal(w: int) -> list[Column]:
    enough = F.col("observations") >= 2
    then = F.coalesce(F.col(f"at_{w}"), F.col("first"))
    of = lambda row, c: F.coalesce(row[c], F.lit(0))
    gain = {c: F.when(enough, F.greatest(F.lit(0), of(F.col("now"), c) - of(then, c))).otherwise(0) for c in _READINGS[:3]}
    hours = F.greatest(F.lit(1.0), hours_between(then["observed_at"], F.col("now.observed_at")))
    raw = F.log1p(gain["stars"] * 24 / hours + 2.5 * (gain["forks"] * 24 / hours) + gain["downloads_30d"] / 1000.0)
    raw = raw + 4.0 * gain["stars"] / F.greatest(F.lit(25), of(then, "stars"))
    coverage = F.least(F.lit(1.0), hours / (w * 24.0))
    signal = F.when(enough, raw * (0.35 + 0.65 * coverage)).otherwise(F.lit(0.0))
    shown = [gain[c].cast("long").alias(f"{c}_gain_{w}d") for c in gain]
    return [*shown, F.when(enough, hours).otherwise(F.lit(0.0)).alias(f"hours_{w}d"), signal.alias(f"growth_{w}d")]
