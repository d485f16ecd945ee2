"""The leaderboard: from growth, attention and evidence to scores, labels and ranks; and reading it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import growth as g
from tidemark.operators.ingest import upsert
from tidemark.operators.ranking import global_rank, percentiles
from tidemark.session import materialize

#: Sort keys of a page and their columns; any other key sorts by score.
SORTS = {"adoption": "adoption_score", "maintenance": "maintenance_score", "quality": "quality_score", "depth": "depth_score", "originality": "originality_score", "attention": "attention_score", "momentum": "rank_delta", "stars": "stars"}


def unique_repositories(repositories: DataFrame) -> DataFrame:
    """Each repository once; a repeated delivery is alike."""
    return repositories.dropDuplicates(["id"])


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """(repository_id, evidence_count, test_count) over all commits."""
    return evidence.groupBy("repository_id").agg(F.count("*").alias("evidence_count"), F.count(F.when(F.col("evidence_type") == "test", 1)).alias("test_count"))


def _e(x: Column) -> Column:
    return 1.0 - F.exp(-x)


def scored(repositories: DataFrame, observations: DataFrame, evidence: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row per repository with observations: signals, component scores, composite score and label.

    vectors: (repository_id, vector_count). Aggregates meet the dimension already reduced to one row per repository.
    """
    signals = g.growth(g.history(observations))
    dim = unique_repositories(repositories).select(F.col("id").alias("repository_id"), "full_name", "license_spdx", "is_archived", "github_updated_at")
    rows = signals.join(dim, "repository_id").join(evidence_counts(evidence), "repository_id", "left").join(vectors, "repository_id", "left")
    rows = rows.fillna(0, ["evidence_count", "test_count", "vector_count"])
    rows = rows.withColumn("attention_raw", F.log1p(F.coalesce("now.stars", F.lit(0)) + 2.0 * F.coalesce("now.forks", F.lit(0))))
    rows = materialize(rows, "signals")
    rows = percentiles(rows, "repository_id", {f"growth_{w}d": f"adoption_{w}d" for w in g.WINDOWS} | {"attention_raw": "attention_score"})
    watermark = rows.agg(F.max("now.observed_at").alias("data_watermark"))
    rows = rows.join(F.broadcast(watermark))
    pushed = F.coalesce("github_updated_at", "now.observed_at")
    recency = F.exp(-F.greatest(F.lit(0.0), g.hours_between(pushed, F.col("data_watermark")) / 24.0) / 75.0)
    stars, issues = F.coalesce("now.stars", F.lit(0)), F.coalesce("now.open_issues", F.lit(0))
    pressure = F.least(F.lit(1.0), issues / F.greatest(F.lit(25.0), stars * 0.05))
    licensed = F.when(F.coalesce("license_spdx", F.lit("")).isin("", "NOASSERTION", "OTHER"), 0.0).otherwise(1.0)
    code = F.when((F.col("evidence_count") > 0) | (F.col("vector_count") > 0), 1.0).otherwise(0.0)
    one = lambda c: F.least(F.lit(1.0), c)
    rows = rows.select(
        "*",
        F.greatest(F.lit(0.0), recency * (1.0 - 0.35 * pressure) * F.when(F.col("is_archived"), 0.0).otherwise(1.0)).alias("maintenance_score"),
        one(0.2 + 0.25 * licensed + 0.25 * code + 0.3 * one(F.col("test_count") / 4.0)).alias("quality_score"),
        one(0.12 + 0.5 * _e(F.col("vector_count") / 18.0) + 0.38 * _e(F.col("evidence_count") / 8.0)).alias("depth_score"),
        one(0.3 + 0.12 * F.least(F.lit(3), F.col("observations")) + 0.2 * code + 0.1 * licensed).alias("confidence"),
    )
    rows = rows.withColumn("originality_score", one(0.55 * (1.0 - F.col("attention_score")) + 0.45 * F.col("depth_score")))
    # The weights of the score, and the thresholds and names of the labels.
    weights = {"adoption_30d": 0.35, "maintenance_score": 0.2, "quality_score": 0.15, "depth_score": 0.12, "originality_score": 0.1, "attention_score": 0.03}
    base = sum((w * F.col(c) for c, w in weights.items()), F.lit(0.05 * 0.5))
    adoption, attention = F.col("adoption_30d"), F.col("attention_score")
    label = (
        F.when(F.col("is_archived") | (F.col("maintenance_score") < 0.24), "At risk")
        .when((adoption >= 0.62) & (attention < 0.48), "Hidden gem")
        .when((attention >= 0.72) & (adoption < 0.34), "Overhyped")
        .when(adoption >= 0.58, "Emerging")
        .otherwise("Durable")
    )
    return rows.withColumn("score", base * (0.8 + 0.2 * F.col("confidence"))).withColumn("label", label).withColumn("explanation", explanation())


#: The version of the features, under which snapshots of the leaderboard are kept.
FEATURE_VERSION = "leaderboard-v1"


def explanation() -> Column:
    """A score's evidence as JSON: what was gained in each window, how many readings, files and chunks there are, and the method."""
    gains = {"stars": "stars", "forks": "forks", "downloads": "downloads_30d"}
    deltas = [F.struct(*[F.col(f"{c}_gain_{w}d").alias(n) for n, c in gains.items()]).alias(str(w)) for w in g.WINDOWS]
    counts = {"observation_count": "observations", "code_evidence": "evidence_count", "vector_chunks": "vector_count"}
    return F.to_json(F.struct(F.struct(*deltas).alias("window_deltas"), *[F.col(c).cast("long").alias(n) for n, c in counts.items()], F.lit(FEATURE_VERSION).alias("method")))


def add_headers(headers: DataFrame, runs: DataFrame) -> DataFrame:
    """The table of runs (feature_version, data_watermark, model_version, created_at) after those of `runs` are written: a run
    that is there already takes the new model_version and keeps its created_at."""
    return upsert(headers, runs, ["feature_version", "data_watermark"], ["model_version"])


def run_recency(headers: DataFrame, *, feature_version: str = FEATURE_VERSION) -> DataFrame:
    """The runs of a feature version with their recency: 1 the current one, 2 the one before. There is one row a run, so few."""
    order = Window.orderBy(F.col("data_watermark").desc(), F.col("created_at").desc())
    return headers.where(F.col("feature_version") == feature_version).withColumn("recency", F.row_number().over(order))


def in_window(days: int | None) -> str:
    """The adoption column of a window: 1, 7 or 90 days, 30 for any other number; what is out of [1, 90] is moved to its nearer end."""
    days = 90 if days is None else max(1, min(days, 90))
    return f"adoption_{days if days in (1, 7, 90) else 30}d"


def materialized(repositories: DataFrame, observations: DataFrame, evidence: DataFrame, vectors: DataFrame) -> DataFrame:
    """The ranked leaderboard: by score (to nine places), then by name; archived repositories are ranked too."""
    rows = scored(repositories, observations, evidence, vectors)
    order = [F.round("score", 9).desc(), F.lower("full_name").asc(), F.col("repository_id").asc()]
    return global_rank(rows, order)


def current_and_previous(items: DataFrame) -> DataFrame:
    """The rows of the latest run with rank and score movements against the run before; null where the repository is new.

    Runs are told apart by their data_watermark, of which there are few; each repository counts once in a run.
    """
    runs = items.select("data_watermark").distinct()
    recency = runs.select("data_watermark", F.row_number().over(Window.orderBy(F.col("data_watermark").desc())).alias("recency"))
    rows = items.dropDuplicates(["full_name", "data_watermark"]).join(F.broadcast(recency), "data_watermark")
    now = rows.where("recency = 1").drop("recency", "rank_delta", "score_delta")
    then = rows.where("recency = 2").select("full_name", F.col("global_rank").alias("prior_rank"), F.col("score").alias("prior_score"))
    moved = now.join(then, "full_name", "left")
    return moved.withColumn("rank_delta", F.col("prior_rank") - F.col("global_rank")).withColumn("score_delta", F.col("score") - F.col("prior_score")).drop("prior_rank", "prior_score")


def window_page(results: DataFrame, prior: DataFrame, repositories: DataFrame, *, window: int | None = 30, **how) -> DataFrame:  # noqa: ANN003
    """One page of a run's results for a window of days, with movements against the run before; archived repositories are ranked but not shown.

    results: of `materialized`; prior: (full_name, prior_rank, prior_score); repositories: owner, language, stars and the like
    by id. Filters look at these as they are; what is shown has defaults for nulls.
    """
    facts = unique_repositories(repositories).where(~F.col("is_archived")).select(F.col("id").alias("repository_id"), "owner", "description", "language", F.col("license_spdx").alias("license"), "stars", "topics", "github_updated_at")
    own = ["repository_id", "full_name", "score", F.col(in_window(window)).alias("adoption_score"), *[f"{c}_score" for c in ("maintenance", "quality", "depth", "originality", "attention")]]
    rows = results.select(*own, F.col("label").alias("status"), "global_rank", "explanation").join(facts, "repository_id").join(prior, "full_name", "left")
    rows = rows.withColumn("rank_delta", F.col("prior_rank") - F.col("global_rank")).withColumn("score_delta", F.col("score") - F.col("prior_score"))
    return _page(rows, **how)


def page(
    items: DataFrame,
    *,
    owner: str | None = None,
    language: str | None = None,
    license: str | None = None,  # noqa: A002
    label: str | None = None,
    sort_by: str | None = "overall",
    limit: int | None = 25,
    offset: int = 0,
) -> DataFrame:
    """One page of the current leaderboard, with the number of rows that match. Filters that are null or blank don't filter.

    Only the page's rows leave the sort (a top-k), the total is a count of its own.
    """
    return _page(current_and_previous(items), owner=owner, language=language, license=license, label=label, sort_by=sort_by, limit=limit, offset=offset)


def _page(
    rows: DataFrame,
    *,
    owner: str | None = None,
    language: str | None = None,
    license: str | None = None,  # noqa: A002
    label: str | None = None,
    sort_by: str | None = "overall",
    limit: int | None = 25,
    offset: int = 0,
) -> DataFrame:
    for column, value in (("owner", owner), ("language", language), ("license", license), ("status", label)):
        if value is not None and value.strip():
            rows = rows.where(F.lower(column) == value.strip().lower())
    rows = rows.select(
        "full_name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("language", F.lit("Unknown")).alias("language"),
        F.coalesce("license", F.lit("NOASSERTION")).alias("license"), "stars", "score", "adoption_score", "maintenance_score", "quality_score",
        "depth_score", "originality_score", "attention_score", F.col("status").alias("label"), "global_rank", "rank_delta", "score_delta",
    )
    total = rows.agg(F.count("*").alias("total_count"))
    order = [] if sort_by is None else [F.col(SORTS.get(sort_by, "score")).desc_nulls_last()]
    limit = 100 if limit is None else max(1, min(limit, 100))
    return rows.orderBy(*order, "full_name").offset(max(0, offset)).limit(limit).join(F.broadcast(total))


def facet(repositories: DataFrame, column: str, *, limit: int = 100) -> DataFrame:
    """The first `limit` values of a column among repositories that aren't archived."""
    rows = repositories.where(~F.col("is_archived") & F.col(column).isNotNull())
    return rows.select(F.col(column).alias("value")).distinct().orderBy("value").limit(limit)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def response_body(items: DataFrame) -> DataFrame:
    """Leaderboard items as the fields of a response: camel-case names, null numbers as 0 but for the two deltas, null texts as their defaults."""
    defaults = {"description": "", "language": "Unknown", "license": "NOASSERTION"}
    numbers = {"stars": 0, "forks": 0, "score": 0.0, "confidence": 0.0, "global_rank": 0, **{f"{c}_score": 0.0 for c in ("adoption", "maintenance", "quality", "depth", "originality", "attention")}}
    filled = [F.coalesce(c, F.lit(v)).alias(camel(c)) for c, v in (defaults | numbers).items()]
    return items.select("item_id", F.col("full_name").alias("fullName"), "owner", "name", *filled, *[F.col(c).alias(camel(c)) for c in ("rank_delta", "score_delta")])
