"""Trailing-period totals and averages of daily gains, per entity and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_readings(obs: DataFrame, *, entity: str, at: str, order: str, metrics: Sequence[str]) -> DataFrame:
    """One row per entity and day with the day's last non-null reading of each metric: (entity, day, m0, m1, ...).

    Of rows with equal entity and instant the one with the smallest `order` (unique, but for repeated rows) stands. Rows without entity or instant are left
    out. A hot entity is spread over its days: rows are shuffled once, by entity and day, and both groupings use that split.
    """
    ms = [F.col(m).alias(f"m{i}") for i, m in enumerate(metrics)]
    rows = obs.select(F.col(entity).alias("entity"), F.col(at).alias("at"), F.col(order).alias("ord"), *ms)
    rows = rows.where("entity is not null and at is not null").withColumn("day", F.to_date("at"))
    names = [f"m{i}" for i in range(len(metrics))]
    once = rows.repartition("entity", "day").groupBy("entity", "day", "at").agg(*[F.min_by(m, "ord").alias(m) for m in names])
    return once.groupBy("entity", "day").agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("at"))).alias(m) for m in names])


def rolling_gains(
    obs: DataFrame,
    *,
    entity: str = "repository_id",
    at: str = "observed_at",
    order: str = "id",
    metrics: Sequence[str] = ("stars", "forks", "downloads_30d"),
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """For each entity, calendar day and metric the total and the daily average of the gains over each trailing period.

    Result: (entity, day, metric, total_P, average_P for each P), one row for every day from the entity's first to its last
    row, days without readings included. A day's gain is its last non-null reading minus the reading of the latest earlier
    day that has one; other days gain 0. Averages divide by the days that exist since the first one.

    Every day's gain is exploded onto the later days it influences, summed by entity and day, and joined to calendar rows, which
    hold each day's own gain, 0 on days without a reading. After `daily_readings` an entity has one row a day, so no group grows
    with the number of readings. Both sides come from one scan and one shuffle by entity, which the join also uses where the
    session's CO_PARTITION setting is false. Empty input gives an empty result;
    repeated rows count once; other columns of the input are ignored.
    """
    n, longest = range(len(metrics)), max(periods)
    days = daily_readings(obs, entity=entity, at=at, order=order, metrics=metrics)
    by_day = Window.partitionBy("entity").orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    gains = days.select(
        "entity",
        "day",
        F.min("day").over(Window.partitionBy("entity")).alias("first_day"),
        F.max("day").over(Window.partitionBy("entity")).alias("last_day"),
        F.lead("day").over(by_day).alias("next_day"),
        *[F.coalesce(F.col(f"m{i}").cast("long") - F.last(f"m{i}", ignorenulls=True).over(before).cast("long"), F.lit(0)).alias(f"g{i}") for i in n],
    )
    some = " or ".join(f"g{i} <> 0" for i in n)
    lags = F.sequence(F.lit(1), F.least(F.lit(longest - 1), F.datediff("last_day", "day")))
    spreaded = gains.where(f"({some}) and last_day > day").select("entity", "day", *[f"g{i}" for i in n], F.explode(lags).alias("lag"))
    totals = spreaded.groupBy("entity", F.date_add("day", F.col("lag")).alias("day")).agg(
        *[F.sum(F.when(F.col("lag") < p, F.col(f"g{i}")).otherwise(0)).alias(f"t{i}_{p}") for i in n for p in periods]
    )
    until = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    calendar = gains.select("entity", "first_day", F.col("day").alias("read"), *[f"g{i}" for i in n], F.explode(F.sequence("day", until, F.expr("interval 1 day"))).alias("day"))
    calendar = calendar.select("entity", "first_day", "day", *[F.when(F.col("day") == F.col("read"), F.col(f"g{i}")).otherwise(0).alias(f"g{i}") for i in n])
    full = calendar.join(totals, ["entity", "day"], "left")
    total = lambda i, p: F.col(f"g{i}") + F.coalesce(f"t{i}_{p}", F.lit(0))
    exist = F.datediff("day", "first_day") + 1
    per_metric = [
        F.struct(
            F.lit(m).alias("metric"),
            *[total(i, p).alias(f"total_{p}") for p in periods],
            *[(total(i, p) / F.least(F.lit(p), exist)).alias(f"average_{p}") for p in periods],
        )
        for i, m in enumerate(metrics)
    ]
    return full.select(F.col("entity").alias(entity), "day", F.explode(F.array(*per_metric)).alias("x")).select(entity, "day", "x.*")
