"""Parquet tables of one input folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: list[str]) -> None:
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
