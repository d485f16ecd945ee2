"""Pairs for learning to rank: hard negatives, targets, a split by time, metrics, and a linear ranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.features import acceleration, adoption_growth, structured_features
from tidemark.operators.ingest import latest_per_key
from tidemark.operators.ranking import global_rank
from tidemark.session import materialize


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The latest capture of each repository regardless of case (of one instant the last landed), numbered by the repository's first row."""
    rows = snapshots.withColumn("repo", F.lower("full_name"))
    first = rows.groupBy("repo").agg(F.min("snapshot_id").alias("ordinal"))
    return latest_per_key(rows, key=F.col("repo"), at="captured_at", order="snapshot_id", first_on_ties=False).join(first, "repo")


def hard_negatives(snapshots: DataFrame, *, positives: Column, n: int = 3) -> DataFrame:
    """(query, positive, negative, overlap, place): for each positive the n other repositories that look most alike to its query.

    Candidates aren't archived and have the positive's language, or any if no other repository has it. They are ranked by
    the share of common tokens, then by their number. Candidates are found by shared tokens, without the language's own
    token, which nearly every candidate of a language has; of those that share no other one, only the first by number of tokens
    and the first by their own number can be among the best, and these are added; at most n + 1 of a pool leave a task for that.
    positives: which repositories to take as queries; every repository is searched.
    """
    latest = materialize(
        latest_snapshots(snapshots).select(
            "repo", "full_name", "ordinal", "snapshot_id", F.coalesce("language", F.lit("Unknown")).alias("language"), F.coalesce("archived", F.lit(False)).alias("archived"),
            text.query_terms().alias("terms"), F.array_distinct(text.tokens(text.repository_text())).alias("tokens"),
        ),
        "latest",
    )
    pool = latest.where(~F.col("archived"))
    sizes = pool.groupBy("language").agg(F.count("*").alias("peers"), F.min("full_name").alias("one"))
    query = F.array_join("terms", " ")
    asked = latest.where(positives).withColumn("query", query).withColumn("q", F.array_distinct(text.tokens(F.col("query")))).where(F.size(text.tokens(F.col("query"))) >= 2)
    asked = asked.join(sizes, "language", "left")
    lonely = F.col("peers").isNull() | ((F.col("peers") == 1) & (F.col("one") == F.col("full_name")))
    asked = asked.select("query", "q", F.col("full_name").alias("positive"), F.col("language").alias("own"), F.when(lonely, "*").otherwise(F.col("language")).alias("pool"))
    everyone = pool.select("full_name", "ordinal", "tokens", F.explode(F.array("language", F.lit("*"))).alias("pool"), "language")
    wanted = everyone.join(asked.select("pool").distinct(), "pool", "left_semi")
    skip = lambda tokens: F.filter(tokens, lambda t: t != F.lower("pool"))
    left = asked.select("query", "positive", "pool", F.explode(skip(F.col("q"))).alias("token"))
    right = wanted.select("pool", F.col("full_name").alias("negative"), F.explode(skip(F.col("tokens"))).alias("token"))
    shared = left.join(right, ["pool", "token"]).where("positive <> negative").groupBy("positive", "negative").agg(F.count("*").alias("n"))
    narrow = wanted.select("pool", "full_name", "ordinal", F.array_contains("tokens", F.lower("language")).alias("speaks"), F.size("tokens").alias("size"))
    orders = ([F.col("speaks").desc(), F.col("size"), F.col("ordinal")], [F.col("ordinal")])
    firsts = [narrow.withColumn("k", F.row_number().over(Window.partitionBy("pool").orderBy(*o))).where(F.col("k") <= n + 1) for o in orders]
    first = firsts[0].unionByName(firsts[1])
    fill = asked.select("positive", "pool").join(first.select("pool", F.col("full_name").alias("negative")), "pool").where("positive <> negative").select("positive", "negative", F.lit(0).cast("long").alias("n"))
    pairs = shared.unionByName(fill).groupBy("positive", "negative").agg(F.max("n").alias("n"))
    speaks = F.array_contains("tokens", F.lower("language"))
    facts = pool.select(F.col("full_name").alias("negative"), "ordinal", F.size("tokens").alias("size"), speaks.alias("speaks"))
    rows = pairs.join(asked.select("query", "positive", "q", "pool"), "positive").join(facts, "negative")
    both = F.col("n") + F.when(F.array_contains("q", F.lower("pool")) & F.col("speaks"), 1).otherwise(0)
    overlap = both / F.greatest(F.lit(1), F.size("q") + F.col("size") - both).cast("double")
    ranked = rows.withColumn("overlap", overlap).withColumn("place", F.row_number().over(Window.partitionBy("positive").orderBy(F.round("overlap", 9).desc(), "ordinal")))
    return ranked.where(F.col("place") <= n).select("query", "positive", "negative", "overlap", "place")


def adoption_targets(snapshots: DataFrame) -> DataFrame:
    """(repo, target): observed growth from the first to the last capture if they are seven days apart, else recent acceleration."""
    rows = snapshots.withColumn("repo", F.lower("full_name"))
    point = F.struct("captured_at", "stars", "forks", "pypi_downloads_30d", acceleration().alias("acceleration"))
    ends = rows.groupBy("repo").agg(F.min_by(point, F.struct("captured_at", "snapshot_id")).alias("first"), F.max_by(point, F.struct("captured_at", "snapshot_id")).alias("last"))
    days = F.datediff("last.captured_at", "first.captured_at")
    apart = (F.unix_micros(F.col("last.captured_at").cast("timestamp")) - F.unix_micros(F.col("first.captured_at").cast("timestamp"))) >= F.lit(7 * 86_400_000_000)
    return ends.select("repo", days.alias("days"), F.when(apart, adoption_growth("first", "last")).otherwise(F.col("last.acceleration")).alias("target"))


def split_by_time(pairs: DataFrame, *, at: str, tie: list[str], share: float = 0.8) -> DataFrame:
    """Add `train`: whether a row is among the first `share` by time, at least one."""
    ranked = global_rank(pairs, [F.col(at).asc(), *[F.col(t).asc() for t in tie]], "_place")
    total = ranked.agg(F.count("*").alias("_all"))
    return ranked.join(F.broadcast(total)).withColumn("train", F.col("_place") <= F.greatest(F.lit(1), F.floor(share * F.col("_all")))).drop("_place", "_all")


def pair_metrics(scored: DataFrame, *, positive: str, negative: str) -> DataFrame:
    """One row: pairs, accuracy (a tie is wrong) and the mean NDCG of pairs."""
    right = F.col(positive) > F.col(negative)
    ndcg = F.when(right, 1.0).otherwise(1.0 / F.log2(F.lit(3.0)))
    return scored.agg(F.count("*").alias("pairs"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("accuracy"), F.avg(ndcg).alias("ndcg"))


def pair_losses(scored: DataFrame, *, positive: str, negative: str, chance: str, target: str) -> DataFrame:
    """One row: the mean softplus of the negative's lead, the mean cross-entropy of the chances (in (0, 1)) whose target isn't null,
    0 if all are, and the number of these."""
    lead = F.col(negative) - F.col(positive)
    softplus = F.greatest(F.lit(0.0), lead) + F.log1p(F.exp(-F.abs(lead)))
    known = F.col(target).isNotNull()
    entropy = -(F.col(target) * F.log(chance) + (1.0 - F.col(target)) * F.log(1.0 - F.col(chance)))
    labels = F.count(F.when(known, 1))
    return scored.agg(F.avg(softplus).alias("pair_loss"), (F.coalesce(F.sum(F.when(known, entropy)), F.lit(0.0)) / F.greatest(F.lit(1), labels)).alias("adoption_loss"), labels.alias("labels"))


def shuffled_batches(rows: DataFrame, *, key: str, seed: int, size: int) -> DataFrame:
    """Add `batch`: the number of a row's batch of `size` after a shuffle that seed and key (unique) settle."""
    ranked = global_rank(rows.withColumn("_shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), [F.col("_shuffle").asc(), F.col(key).asc()], "_place")
    return ranked.withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_shuffle", "_place")


def save_ranker(spark: SparkSession, weights: list[float], path: str) -> None:
    """Write a ranker's weights by the names of their features."""
    spark.createDataFrame(list(zip(structured_features(), weights, strict=True)), "feature string, weight double").coalesce(1).write.mode("overwrite").json(path)


def load_ranker(spark: SparkSession, path: str) -> list[float]:
    """The weights in the order of the features; a feature that the table lacks, or knows besides, fails."""
    found = {r.feature: r.weight for r in spark.read.schema("feature string, weight double").json(path).collect()}  # one row a feature
    if found.keys() != structured_features().keys():
        raise ValueError("the ranker was made for other features")
    return [found[c] for c in structured_features()]


def train_ranker(pairs: DataFrame, snapshots: DataFrame) -> list[float]:
    """A linear ranker fitted by logistic regression on differences of the snapshots' features: its weights, zeros without pairs.

    pairs: (positive, negative) names. Each pair is used in both directions, so no intercept is learned.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = list(structured_features())
    rows = feature_rows(snapshots)
    a, b = (rows.select(F.col("full_name").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in ("positive", "negative"))
    both = pairs.select("positive", "negative").join(a, "positive").join(b, "negative")
    ways = [both.select(F.lit(label).alias("label"), *[((F.col(f"positive_{c}") - F.col(f"negative_{c}")) * sign).alias(c) for c in names]) for label, sign in ((1.0, 1.0), (0.0, -1.0))]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(ways[0].unionByName(ways[1])).persist()
    if data.isEmpty():
        return [0.0] * len(names)
    weights = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=30).fit(data).coefficients.toArray().tolist()
    data.unpersist()
    return weights


def feature_rows(snapshots: DataFrame) -> DataFrame:
    """(full_name, the features) of the latest capture of each repository."""
    return latest_snapshots(snapshots).select("full_name", *[c.alias(n) for n, c in structured_features().items()])


def ranker_scores(weights: list[float], snapshots: DataFrame) -> DataFrame:
    """(full_name, score): the linear score of each repository's features."""
    score = F.lit(0.0)
    for name, w in zip(structured_features(), weights, strict=True):
        score = score + F.lit(w) * F.col(name)
    return feature_rows(snapshots).select("full_name", score.alias("score"))
