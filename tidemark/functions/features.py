"""The numeric features of a snapshot, and growth between two of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.growth import hours_between


def _or(c: str, default: float = 0) -> Column:
    return F.coalesce(c, F.lit(default))


def recency(at: str, now: str, days: float) -> Column:
    """exp(-age / days); 0 for null."""
    age = F.greatest(F.lit(0.0), hours_between(F.col(at), F.col(now)) / 24.0)
    return F.when(F.col(at).isNull(), 0.0).otherwise(F.exp(-age / days))


def structured_features(now: str = "captured_at") -> dict[str, Column]:
    one = lambda c: F.least(F.lit(1.0), c)
    floor = lambda c, least: F.greatest(F.lit(least), c)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    sources = _or("source_file_count")
    age = F.coalesce(F.greatest(F.lit(0.0), hours_between(F.col("created_at"), F.col(now)) / 24.0), F.lit(0.0))
    return {
        "log_stars": F.log1p(_or("stars")) / 12.0,
        "log_forks": F.log1p(_or("forks")) / 10.0,
        "issue_pressure": one(_or("open_issues") / floor(_or("stars") * 0.05, 25.0)),
        "push_recency": recency("pushed_at", now, 45.0),
        "has_license": flag(~F.coalesce("license_spdx", F.lit("NOASSERTION")).isin("", "NOASSERTION", "OTHER")),
        "is_archived": flag(F.coalesce("archived", F.lit(False))),
        "topic_density": one(F.coalesce(F.size("topics"), F.lit(0)) / 12.0),
        "description_density": one(F.size(tokens(F.col("description"))) / 80.0),
        "release_recency": recency("latest_release_at", now, 120.0),
        "log_pypi_downloads": F.log1p(_or("pypi_downloads_30d")) / 18.0,
        "log_contributors": F.log1p(_or("contributors_sampled")) / 6.0,
        "repository_age": one(age / 3650.0),
        "has_code_index": flag(F.coalesce("indexed_commit_sha", F.lit("")) != ""),
        "test_coverage_proxy": one(_or("test_file_count") / floor(sources * 0.35, 1.0)),
        "example_coverage_proxy": one(_or("example_file_count") / floor(sources * 0.15, 1.0)),
        "dependency_density": one(_or("dependency_count") / 80.0),
        "symbol_density": one(_or("symbol_count") / floor(sources * 30.0, 20.0)),
        "quality": _or("quality_score", 0.0),
        "depth": _or("depth_score", 0.0),
        "originality": _or("originality_score", 0.0),
    }


def adoption_growth(first: str, last: str) -> Column:
    """1 - exp(-log1p(stars a day + 2 forks a day + 10 times relative downloads) / 2) between two snapshot structs."""
    days = F.greatest(F.lit(1.0), hours_between(F.col(f"{first}.captured_at"), F.col(f"{last}.captured_at")) / 24.0)
    gain = lambda c: F.greatest(F.lit(0.0), (F.col(f"{last}.{c}") - F.col(f"{first}.{c}")).cast("double")) / days
    a, b = (F.coalesce(f"{x}.pypi_downloads_30d", F.lit(0)).cast("double") for x in (first, last))
    downloads = F.when((a != 0) & (b != 0), F.greatest(F.lit(0.0), b / F.nullif(a, F.lit(0.0)) - 1.0)).otherwise(0.0)
    return 1.0 - F.exp(-F.log1p(gain("stars") + 2.0 * gain("forks") + 10.0 * downloads) / 2.0)


def acceleration() -> Column:
    """Recent daily downloads against those of the rest of the month; null if either reading is."""
    week, month = F.col("pypi_downloads_7d").cast("double"), F.col("pypi_downloads_30d").cast("double")
    before = F.greatest(F.lit(0.0), month - week) / 23.0
    change = (week / 7.0 - before) / F.greatest(F.lit(1.0), before)
    return F.when(week.isNull() | month.isNull(), None).when(month == 0, 0.0).otherwise(1.0 / (1.0 + F.exp(-2.0 * change)))
