"""Queries of the sentences of documents and of the source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import sentences, sourcefiles
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()


@R.query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.split_documents(table(spark, folder, "documents"))


@R.query("p8_abbreviations")
def p8_abbreviations(spark: SparkSession, folder: str) -> DataFrame:
    """What the corpus shows of words written with a period."""
    return sentences.abbreviations(table(spark, folder, "documents"))


@R.query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The source files that nobody wrote by hand for their repository."""
    return sourcefiles.not_by_hand(table(spark, folder, "source_files"), table(spark, folder, "repositories"))


@R.query("p1_kept")
def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The hand-written files that remain: each path once."""
    files = table(spark, folder, "source_files")
    return files.where("full_name is not null and path is not null").select("full_name", "path").distinct().join(p1_found(spark, folder), ["full_name", "path"], "left_anti")
