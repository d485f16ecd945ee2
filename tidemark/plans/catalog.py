"""The registries of the core, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import code, display, ingest, leaderboard, pairs, rolling_history, search

REGISTRIES = [leaderboard.R, code.R, display.R, search.R, pairs.R, ingest.R, rolling_history.R]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard.leaderboard_full(spark, folder)
