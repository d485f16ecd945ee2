"""Queries of features and of pairs for learning to rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import features, text
from tidemark.operators import pairs
from tidemark.plans.registry import Registry
from tidemark.session import fresh
from tidemark.sources.tables import table

R = Registry()

_T = "regexp_extract_all(lower({}), '[a-z0-9][a-z0-9_+.-]{{1,}}')"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + "]"
#: Distinct in the order of first use.
_ORDERED = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_TERMS = f"""terms as (select *, list_concat(list_concat(coalesce(flatten(list_transform(list_slice(topics, 1, 5), lambda t: {_T.format('t')})), []),
  list_slice(list_filter(coalesce({_T.format('description')}, []), lambda w: not list_contains({_STOP}, w)), 1, 8)), [lower(coalesce(language, 'Unknown'))]) as w from SRC)"""
_QUERY = f"list_slice({_ORDERED.format(x='w')}, 1, 12)"
_TEXT = """array_to_string(list_filter([replace(full_name, '/', ' '), description, array_to_string(topics, ' '), coalesce(language, 'Unknown'), array_to_string(code_terms, ' '),
  array_to_string(code_evidence_paths, ' '), architecture_summary], lambda x: x is not null and x <> ''), ' ')"""


@R.query("query_from_repo", f"with {_TERMS.replace('SRC', 'repository_snapshots')} select snapshot_id, array_to_string({_QUERY}, ' ') as query from terms")
def query_from_repo(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "repository_snapshots").select("snapshot_id", F.array_join(text.query_terms(), " ").alias("query"))


@R.query("hard_negatives", f"""with l as (select * from (select *, lower(full_name) as repo, min(snapshot_id) over (partition by lower(full_name)) as ordinal, row_number() over (partition by lower(full_name) order by captured_at desc, snapshot_id desc) as n
  from repository_snapshots) where n = 1), {_TERMS.replace('SRC', 'l')},
a as (select repo, full_name, ordinal, snapshot_id, coalesce(language, 'Unknown') as language, coalesce(archived, false) as archived, array_to_string({_QUERY}, ' ') as query, list_distinct({_T.format(_TEXT)}) as tokens from terms),
p as (select *, list_distinct({_T.format('query')}) as q from a where ordinal % 20 = 0 and len({_T.format('query')}) >= 2),
j as (select p.query, p.full_name as positive, n.full_name as negative, n.ordinal, n.language = p.language as alike, len(list_intersect(p.q, n.tokens)) as common, len(p.q) + len(n.tokens) as whole from p join a n on n.full_name <> p.full_name and not n.archived),
k as (select *, max(alike) over (partition by positive) as any_alike, common / greatest(1, whole - common)::double as overlap from j),
r as (select *, row_number() over (partition by positive order by round(overlap, 9) desc, ordinal) as place from k where alike or not any_alike)
select query, positive, negative, round(overlap, 6) as overlap, place from r where place <= 3""")  # fmt: skip
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives for every repository whose number is divisible by 20, searched among all repositories."""
    rows = pairs.hard_negatives(table(spark, folder, "repository_snapshots"), positives=F.col("ordinal") % 20 == 0)
    return rows.withColumn("overlap", F.round("overlap", 6)).withColumn("place", F.col("place").cast("long"))


def _hours(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 3.6e9"


_ACC = """case when pypi_downloads_7d is null or pypi_downloads_30d is null then null when pypi_downloads_30d = 0 then 0.0e0 else
  1.0e0 / (1.0e0 + exp(-2.0e0 * (pypi_downloads_7d / 7.0e0 - greatest(0.0e0, pypi_downloads_30d - pypi_downloads_7d) / 23.0e0) / greatest(1.0e0, greatest(0.0e0, pypi_downloads_30d - pypi_downloads_7d) / 23.0e0))) end"""


@R.query("adoption_targets", f"""with s as (select *, lower(full_name) as repo, {_ACC} as acc from repository_snapshots),
e as (select repo, arg_min(struct_pack(t := captured_at, s := stars, f := forks, d := pypi_downloads_30d), row(captured_at, snapshot_id)) as a, arg_max(struct_pack(t := captured_at, s := stars, f := forks, d := pypi_downloads_30d, c := acc), row(captured_at, snapshot_id)) as b from s group by repo),
g as (select *, greatest(1.0e0, {_hours('a.t', 'b.t')} / 24.0e0) as days from e)
select repo, round(case when epoch_us(b.t) - epoch_us(a.t) >= 7 * 86400000000 then 1.0e0 - exp(-ln(1 + greatest(0, b.s - a.s) / days + 2.0e0 * greatest(0, b.f - a.f) / days
  + 10.0e0 * case when coalesce(a.d, 0) <> 0 and coalesce(b.d, 0) <> 0 then greatest(0.0e0, b.d / nullif(a.d, 0)::double - 1.0e0) else 0.0e0 end) / 2.0e0) else b.c end, 6) as target from g""")  # fmt: skip
def adoption_targets(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.adoption_targets(table(spark, folder, "repository_snapshots")).select("repo", F.round("target", 6).alias("target"))


@R.query("acceleration", f"select snapshot_id, round({_ACC}, 6) as acceleration from repository_snapshots")
def acceleration(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "repository_snapshots").select("snapshot_id", F.round(features.acceleration(), 6).alias("acceleration"))


def _recency(c: str, days: float) -> str:
    return f"case when {c} is null then 0.0e0 else exp(-greatest(0.0e0, {_hours(c, 'captured_at')} / 24.0e0) / {days}e0) end"


_FEATURES = {
    "log_stars": "ln(1 + stars) / 12.0e0", "log_forks": "ln(1 + forks) / 10.0e0", "issue_pressure": "least(1.0e0, open_issues / greatest(stars * 0.05e0, 25.0e0))", "push_recency": _recency("pushed_at", 45.0),
    "has_license": "case when coalesce(license_spdx, 'NOASSERTION') in ('', 'NOASSERTION', 'OTHER') then 0.0e0 else 1.0e0 end", "is_archived": "case when coalesce(archived, false) then 1.0e0 else 0.0e0 end",
    "topic_density": "least(1.0e0, len(topics) / 12.0e0)", "description_density": f"least(1.0e0, len(coalesce({_T.format('description')}, [])) / 80.0e0)", "release_recency": _recency("latest_release_at", 120.0),
    "log_pypi_downloads": "ln(1 + coalesce(pypi_downloads_30d, 0)) / 18.0e0", "log_contributors": "ln(1 + contributors_sampled) / 6.0e0", "repository_age": f"least(1.0e0, coalesce(greatest(0.0e0, {_hours('created_at', 'captured_at')} / 24.0e0), 0.0e0) / 3650.0e0)",
    "has_code_index": "case when coalesce(indexed_commit_sha, '') <> '' then 1.0e0 else 0.0e0 end", "test_coverage_proxy": "least(1.0e0, test_file_count / greatest(source_file_count * 0.35e0, 1.0e0))",
    "example_coverage_proxy": "least(1.0e0, example_file_count / greatest(source_file_count * 0.15e0, 1.0e0))", "dependency_density": "least(1.0e0, dependency_count / 80.0e0)", "symbol_density": "least(1.0e0, symbol_count / greatest(source_file_count * 30.0e0, 20.0e0))",
    "quality": "quality_score", "depth": "depth_score", "originality": "originality_score",
}


@R.query("structured_features", "select snapshot_id, " + ", ".join(f"round({e}, 6) as {n}" for n, e in _FEATURES.items()) + " from repository_snapshots")
def structured_features(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty features of every snapshot."""
    return table(spark, folder, "repository_snapshots").select("snapshot_id", *[F.round(c, 6).alias(n) for n, c in features.structured_features().items()])


_SPLIT = "r as (select *, row_number() over (order by captured_at, snapshot_id) as n, count(*) over () as total from repository_snapshots)"


@R.query("time_split", f"with {_SPLIT} select snapshot_id, n <= greatest(1, cast(floor(0.8e0 * total) as bigint)) as train from r")
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    """The first four fifths of the captures by time."""
    rows = table(spark, folder, "repository_snapshots").select("snapshot_id", "captured_at")
    return pairs.split_by_time(rows, at="captured_at", tie=["snapshot_id"]).select("snapshot_id", "train")


@R.query("pair_metrics", """with s as (select full_name, lead(score) over (order by full_name, item_id) as other, score from leaderboard_items), p as (select score as a, other as b from s where score is not null and other is not null)
select count(*) as pairs, round(avg(case when a > b then 1.0e0 else 0.0e0 end), 6) as accuracy, round(avg(case when a > b then 1.0e0 else 1.0e0 / log2(3.0e0) end), 6) as ndcg from p""")  # fmt: skip
def pair_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of pairs of neighbours in the order of names."""
    from tidemark.operators.ranking import global_rank

    items = global_rank(table(spark, folder, "leaderboard_items").select("full_name", "item_id", "score"), [F.col("full_name").asc(), F.col("item_id").asc()], "n")
    other = items.select((F.col("n") - 1).alias("n"), F.col("score").alias("other"))
    scored = items.join(other, "n").where("score is not null and other is not null")
    return pairs.pair_metrics(scored, positive="score", negative="other").select("pairs", F.round("accuracy", 6).alias("accuracy"), F.round("ndcg", 6).alias("ndcg"))


#: Positives whose pairs train the ranker: those whose number is divisible by it. A bound on the training, not on what is scored.
TRAINED = 20


@R.query("ranker_train_score")
def ranker_train_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all repositories by a linear ranker trained on the hard negatives of one positive in TRAINED, saved and loaded again."""
    snapshots = table(spark, folder, "repository_snapshots")
    found = pairs.hard_negatives(snapshots, positives=F.col("ordinal") % TRAINED == 0)
    at = fresh(spark, "ranker")
    pairs.save_ranker(spark, pairs.train_ranker(found, snapshots), at)
    return pairs.ranker_scores(pairs.load_ranker(spark, at), snapshots)


_SCORED = """s as (select full_name, lead(score) over (order by full_name, item_id) as b, score as a, adoption_score as t, quality_score as c from leaderboard_items)"""


@R.query(
    "pair_losses",
    f"""with {_SCORED}, p as (select *, least(0.999e0, greatest(0.001e0, c)) as q, case when a >= 0.5e0 then t end as y from s where a is not null and b is not null)
select round(avg(greatest(0.0e0, b - a) + ln(1.0e0 + exp(-abs(b - a)))), 6) as pair_loss, round(coalesce(sum(-(y * ln(q) + (1.0e0 - y) * ln(1.0e0 - q))), 0.0e0) / greatest(1, count(y)), 6) as adoption_loss, count(y) as labels from p""",
)
def pair_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of pairs of neighbours in the order of names; scores of a half and more have an adoption target."""
    from tidemark.operators.ranking import global_rank

    items = global_rank(table(spark, folder, "leaderboard_items").select("full_name", "item_id", "score", "adoption_score", "quality_score"), [F.col("full_name").asc(), F.col("item_id").asc()], "n")
    other = items.select((F.col("n") - 1).alias("n"), F.col("score").alias("other"))
    rows = items.join(other, "n").where("score is not null and other is not null")
    rows = rows.select("score", "other", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("quality_score"))).alias("chance"), F.when(F.col("score") >= 0.5, F.col("adoption_score")).alias("target"))
    found = pairs.pair_losses(rows, positive="score", negative="other", chance="chance", target="target")
    return found.select(F.round("pair_loss", 6).alias("pair_loss"), F.round("adoption_loss", 6).alias("adoption_loss"), "labels")


@R.query("shuffled_batches", "select snapshot_id, (row_number() over (order by md5('7:' || snapshot_id), snapshot_id) - 1) // 64 as batch from repository_snapshots")
def shuffled_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots in shuffled batches of 64."""
    return pairs.shuffled_batches(table(spark, folder, "repository_snapshots").select("snapshot_id"), key="snapshot_id", seed=7, size=64)
