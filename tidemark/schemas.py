"""Explicit schemas of landed records, and the defaults that stand for missing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = "stars forks open_issues watchers size_kb contributors_sampled source_file_count test_file_count example_file_count dependency_count symbol_count".split()
_LONGS = "pypi_downloads_1d pypi_downloads_7d pypi_downloads_30d".split()
_TIMES = "captured_at pushed_at created_at latest_release_at pypi_latest_release".split()
_ARRAYS = "topics code_terms code_evidence_paths code_chunks".split()
_DOUBLES = "quality_score depth_score originality_score".split()
_TEXTS = "full_name html_url description language license_spdx pypi_package source_query indexed_commit_sha architecture_summary".split()
_FLAGS = "archived fork".split()

_TYPES = (
    [(c, T.StringType()) for c in _TEXTS] + [(c, T.TimestampNTZType()) for c in _TIMES] + [(c, T.IntegerType()) for c in _INTS] + [(c, T.LongType()) for c in _LONGS]
    + [(c, T.ArrayType(T.StringType())) for c in _ARRAYS] + [(c, T.BooleanType()) for c in _FLAGS] + [(c, T.DoubleType()) for c in _DOUBLES]
)
SNAPSHOT = T.StructType([T.StructField(c, t) for c, t in _TYPES])
PAIR = T.StructType([T.StructField("query", T.StringType()), T.StructField("positive", SNAPSHOT), T.StructField("negative", SNAPSHOT), T.StructField("adoption_target", T.DoubleType()), T.StructField("observed_at", T.TimestampNTZType())])
#: The event contract: its required fields; what else a record holds stays in `payload`.
OBSERVATION_EVENT = T.StructType([T.StructField(c, T.StringType()) for c in ("schema_version", "event_id", "source", "captured_at", "full_name", "html_url")])

#: A raw search result as the code host sends it.
RAW_ITEM = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("full_name", "html_url", "description", "language")], T.StructField("license", T.StructType([T.StructField("spdx_id", T.StringType())])), T.StructField("topics", T.ArrayType(T.StringType())),
    *[T.StructField(c, T.IntegerType()) for c in ("stargazers_count", "forks_count", "open_issues_count", "subscribers_count", "watchers_count", "size")],
    *[T.StructField(c, T.BooleanType()) for c in ("archived", "fork")], *[T.StructField(c, T.TimestampNTZType()) for c in ("pushed_at", "created_at")],
])

#: Defaults of a snapshot's missing fields; fields that aren't here stay null.
DEFAULTS = {"description": "", "language": "Unknown", "license_spdx": "NOASSERTION", "source_query": "", "architecture_summary": ""} | dict.fromkeys(_INTS, 0) | dict.fromkeys(_FLAGS, False) | dict.fromkeys(_DOUBLES, 0.0)


def with_defaults(snapshots: DataFrame) -> DataFrame:
    """Fill missing fields; rows without one of the three required fields fail the query."""
    rows = snapshots.fillna({c: v for c, v in DEFAULTS.items() if c in snapshots.columns})
    for c in (a for a in _ARRAYS if a in snapshots.columns):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    for c in ("full_name", "html_url", "captured_at"):
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a snapshot lacks {c}"))).otherwise(F.col(c)))
    return rows
