"""Queries of ingest: sources, deduplication, upserts, retention, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.operators import codebase, ingest, leaderboard
from tidemark.plans.registry import Registry
from tidemark.schemas import RAW_ITEM, SNAPSHOT
from tidemark.session import fresh
from tidemark.sources import jsonl
from tidemark.sources.tables import table
from tidemark.streaming import ingest as streaming

R = Registry()
CUT = "2026-03-01"


def _time(c: str):  # noqa: ANN202
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


_JSONL = """select full_name, strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f') as captured_at, coalesce(description, '') as description, coalesce(language, 'Unknown') as language,
  coalesce(license_spdx, 'NOASSERTION') as license_spdx, array_to_string(topics, ' ') as topics, stars, coalesce(archived, false) as archived, coalesce(fork, false) as fork, pypi_downloads_30d,
  len(code_chunks) as chunks, round(quality_score, 6) as quality_score from repository_snapshots"""


@R.query("snapshot_scan", _JSONL)
def snapshot_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots, written as JSON lines sorted by name and read again with their schema and defaults."""
    at = fresh(spark, "snapshots")
    jsonl.write_lines(table(spark, folder, "repository_snapshots").select(*SNAPSHOT.names), at)
    rows = jsonl.read_snapshots(spark, [at])
    return rows.select(
        "full_name", _time("captured_at"), "description", "language", "license_spdx", F.array_join("topics", " ").alias("topics"), "stars", "archived", "fork", "pypi_downloads_30d",
        F.size("code_chunks").cast("long").alias("chunks"), F.round("quality_score", 6).alias("quality_score"),
    )


@R.query("raw_hydrate", """select full_name, coalesce(nullif(description, ''), '') as description, coalesce(nullif(language, ''), 'Unknown') as language, coalesce(nullif(license_spdx, ''), 'NOASSERTION') as license_spdx,
  coalesce(nullif(watchers, 0), nullif(stars, 0), 0) as watchers, coalesce(archived, false) as archived from repository_snapshots""")  # fmt: skip
def raw_hydrate(spark: SparkSession, folder: str) -> DataFrame:
    return jsonl.hydrated(table(spark, folder, "repository_snapshots"))


@R.query("items_hydrate", """select full_name, html_url, strftime(captured_at, '%Y-%m-%d %H:%M:%S.%f') as captured_at, coalesce(description, '') as description, coalesce(nullif(language, ''), 'Unknown') as language, coalesce(nullif(license_spdx, ''), 'NOASSERTION') as license_spdx,
  array_to_string(topics, ' ') as topics, stars, forks, open_issues, size_kb, case when snapshot_id % 3 <> 0 and watchers <> 0 then watchers else stars end as watchers, coalesce(archived, false) as archived, coalesce(fork, false) as fork, strftime(pushed_at, '%Y-%m-%d %H:%M:%S.%f') as pushed_at, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') as created_at, 'topic:cli' as source_query
  from (select * replace (coalesce(stars, 0) as stars, coalesce(forks, 0) as forks, coalesce(open_issues, 0) as open_issues, coalesce(size_kb, 0) as size_kb) from repository_snapshots)""")  # fmt: skip
def items_hydrate(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots turned back into raw search results, landed as JSON lines, and hydrated; a third lacks the count of subscribers."""
    at = fresh(spark, "items")
    rows = table(spark, folder, "repository_snapshots")
    renamed = {"stargazers_count": "stars", "forks_count": "forks", "open_issues_count": "open_issues", "watchers_count": "stars", "size": "size_kb"}
    raw = rows.select(
        "full_name", "html_url", "captured_at", "description", "language", F.struct(F.col("license_spdx").alias("spdx_id")).alias("license"), "topics", *[F.col(c).alias(n) for n, c in renamed.items()],
        F.when(F.col("snapshot_id") % 3 == 0, 0).otherwise(F.col("watchers")).alias("subscribers_count"), "archived", "fork", "pushed_at", "created_at",
    )
    raw.write.json(at)
    landed = spark.read.schema(T.StructType([*RAW_ITEM.fields, T.StructField("captured_at", T.TimestampNTZType())])).json(at)
    found = jsonl.hydrated_items(landed, captured_at=F.col("captured_at"), source_query="topic:cli")
    return found.withColumn("topics", F.array_join("topics", " ")).withColumns({c: _time(c) for c in ("captured_at", "pushed_at", "created_at")})


@R.query("pair_scan", """with e as (select lower(full_name) as repo, arg_max(struct_pack(i := snapshot_id, n := full_name, s := stars, d := coalesce(description, '')), snapshot_id) as p, arg_min(struct_pack(i := snapshot_id, n := full_name, s := stars), snapshot_id) as m, max(quality_score) as target from repository_snapshots group by 1 having count(*) > 1)
select repo as query, p.n as positive, coalesce(p.s, 0) as positive_stars, p.d as positive_description, m.n as negative, coalesce(m.s, 0) as negative_stars, round(target, 6) as adoption_target from e""")  # fmt: skip
def pair_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of the latest and the first capture of each repository, landed as JSON lines and read again with their schema."""
    at = fresh(spark, "pairs")
    capture = F.struct(*SNAPSHOT.names)
    rows = table(spark, folder, "repository_snapshots").groupBy(F.lower("full_name").alias("query")).agg(
        F.max_by(capture, "snapshot_id").alias("positive"), F.min_by(capture, "snapshot_id").alias("negative"), F.max("quality_score").alias("adoption_target"), F.max("captured_at").alias("observed_at"), F.count("*").alias("n")
    )
    rows.where("n > 1").drop("n").write.json(at)
    shown = [F.col(f"{side}.full_name").alias(side) for side in ("positive", "negative")] + [F.coalesce(f"{side}.stars", F.lit(0)).alias(f"{side}_stars") for side in ("positive", "negative")]
    return jsonl.read_pairs(spark, at).select("query", *shown, F.coalesce("positive.description", F.lit("")).alias("positive_description"), F.round("adoption_target", 6).alias("adoption_target"))


@R.query("seed_queries", "select name || ' ' || k as query from (select name, unnest([1, 2]) as k from (select distinct name from repositories)) where k = 1 or not starts_with(name, 's')")
def seed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Lines made of repository names: some blank, some with white space around them, some that only seem to be remarks, some that are."""
    at = fresh(spark, "seeds")
    names = table(spark, folder, "repositories").select("name").distinct()
    second = F.when(F.col("name").startswith("s"), F.concat(F.lit("# "), "name")).otherwise(F.concat("name", F.lit(" 2")))
    names.select(F.explode(F.array(F.concat(F.lit("  "), "name", F.lit(" 1 ")), F.lit("   "), F.lit(""), second)).alias("value")).write.text(at)
    return jsonl.read_seed_queries(spark, at)


@R.query("package_candidates", """with p as (select distinct pypi_package as package from repository_snapshots where pypi_package is not null), n as (select distinct name from repositories),
t as (select name, 0 as pos, name as package from n union all select name, 1, replace(name, '_', '-') from n union all select name, 2, replace(name, '-', '_') from n)
select name, arg_min(package, pos) as package from t join p using (package) group by name""")  # fmt: skip
def package_candidates(spark: SparkSession, folder: str) -> DataFrame:
    packages = table(spark, folder, "repository_snapshots").where("pypi_package is not null").select(F.col("pypi_package").alias("package"))
    return jsonl.package_names(table(spark, folder, "repositories"), packages)


@R.query("owner_name_split", "select distinct full_name, string_split(full_name, '/')[1] as owner, regexp_replace(full_name, '^[^/]*/', '') as name from repositories")
def owner_name_split(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("full_name")
    return table(spark, folder, "repositories").select(c, text.owner_of(c).alias("owner"), text.name_of(c).alias("name")).distinct()


@R.query("repository_text", """select snapshot_id, array_to_string(list_filter([replace(full_name, '/', ' '), description, array_to_string(topics, ' '), coalesce(language, 'Unknown'), array_to_string(code_terms, ' '),
  array_to_string(code_evidence_paths, ' '), architecture_summary], lambda x: x is not null and x <> ''), ' ') as text from repository_snapshots""")  # fmt: skip
def repository_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "repository_snapshots").select("snapshot_id", text.repository_text().alias("text"))


def _dedupe(name: str, tie: str, first: bool) -> None:
    @R.query(name, f"select lower(full_name) as repo, snapshot_id from (select *, row_number() over (partition by lower(full_name) order by captured_at desc, snapshot_id {tie}) as n from repository_snapshots) where n = 1")
    def dedupe(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "repository_snapshots").select("full_name", "captured_at", "snapshot_id")
        return ingest.latest_per_key(rows, key=F.lower("full_name"), at="captured_at", order="snapshot_id", first_on_ties=first).select(F.lower("full_name").alias("repo"), "snapshot_id")


_dedupe("dedupe_first_tie", "asc", True)
_dedupe("dedupe_last_tie", "desc", False)

_LATEST = "b as (select * from (select *, row_number() over (partition by full_name order by captured_at desc, snapshot_id desc) as k from repository_snapshots) where k = 1)"
_UNIQUE = "o as (select distinct on (id) * from repositories)"


def _batch(spark: SparkSession, folder: str) -> DataFrame:
    """The latest snapshot of each exact name."""
    return ingest.latest_per_key(table(spark, folder, "repository_snapshots"), key=F.col("full_name"), at="captured_at", order="snapshot_id", first_on_ties=False)


@R.query("upsert_repositories", f"""with {_UNIQUE}, {_LATEST}
select coalesce(o.full_name, b.full_name) as full_name, case when o.full_name is null then string_split(b.full_name, '/')[1] else o.owner end as owner, case when b.full_name is null then o.description else b.description end as description,
  case when b.full_name is null then o.language else b.language end as language, case when b.full_name is null then o.stars else b.stars end as stars, case when b.full_name is null then o.forks else b.forks end as forks
from o full join b on o.full_name = b.full_name""")  # fmt: skip
def upsert_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """The repositories after an upsert of the latest snapshots: names and owners stay, descriptions and counts are overwritten."""
    old = leaderboard.unique_repositories(table(spark, folder, "repositories")).select("full_name", "owner", "description", "language", "stars", "forks")
    new = _batch(spark, folder).select("full_name", text.owner_of(F.col("full_name")).alias("owner"), "description", "language", "stars", "forks")
    return ingest.upsert(old, new, ["full_name"], ["description", "language", "stars", "forks"])


_OBS_KEYS = ["repository_id", "source", "observed_at"]


@R.query("insert_observations", f"""with old as (select * from (select *, row_number() over (partition by repository_id, source, observed_at order by id) as k from repository_observations where observed_at < timestamp '{CUT}') where k = 1),
new as (select * from (select *, row_number() over (partition by repository_id, source, observed_at order by id) as k from repository_observations where observed_at >= timestamp '{CUT}' - interval 10 day) where k = 1),
u as (select * from old union all select * from new where not exists (select 1 from old where old.repository_id = new.repository_id and old.source = new.source and old.observed_at = new.observed_at))
select id, repository_id, source, strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') as observed_at, stars from u""")  # fmt: skip
def insert_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations before March, and those from ten days earlier on inserted where they are absent."""
    rows = table(spark, folder, "repository_observations").select("id", *_OBS_KEYS, "stars")
    cut = F.lit(CUT).cast("timestamp_ntz")
    none = rows.limit(0)
    old = ingest.insert_if_absent(none, rows.where(F.col("observed_at") < cut), _OBS_KEYS, order="id")
    new = rows.where(F.col("observed_at") >= cut - F.expr("interval 10 days"))
    return ingest.insert_if_absent(old, new, _OBS_KEYS, order="id").select("id", "repository_id", "source", _time("observed_at"), "stars")


@R.query("update_indexed", f"""with {_UNIQUE}, b as (select full_name, arg_max(indexed_commit_sha, row(captured_at, snapshot_id)) as sha from repository_snapshots where indexed_commit_sha <> '' group by full_name)
select o.full_name, coalesce(b.sha, o.indexed_commit_sha) as indexed_commit_sha from o left join b using (full_name)""")  # fmt: skip
def update_indexed(spark: SparkSession, folder: str) -> DataFrame:
    old = leaderboard.unique_repositories(table(spark, folder, "repositories")).select("full_name", "indexed_commit_sha")
    new = table(spark, folder, "repository_snapshots").where("indexed_commit_sha <> ''")
    new = new.groupBy("full_name").agg(F.max_by("indexed_commit_sha", F.struct("captured_at", "snapshot_id")).alias("indexed_commit_sha"))
    return ingest.update_matched(old, new, ["full_name"], ["indexed_commit_sha"])


_CHUNKS = """c as (select r.id as repository_id, indexed_commit_sha as commit_sha, k as chunk_index, sha256(code_chunks[k + 1]) as content_hash, landed_at, snapshot_id
  from (select *, unnest(range(0, len(code_chunks))) as k from repository_snapshots where indexed_commit_sha <> '') s join (select distinct id, full_name from repositories) r using (full_name) where code_chunks[k + 1] <> '')"""


@R.query("upsert_vectors", f"""with {_CHUNKS},
o as (select * from (select *, row_number() over (partition by repository_id, commit_sha, chunk_index order by landed_at desc, snapshot_id desc) as n from c where landed_at < timestamp '{CUT}') where n = 1),
b as (select * from (select *, row_number() over (partition by repository_id, commit_sha, chunk_index order by landed_at desc, snapshot_id desc) as n from c where landed_at >= timestamp '{CUT}') where n = 1)
select coalesce(b.repository_id, o.repository_id) as repository_id, coalesce(b.commit_sha, o.commit_sha) as commit_sha, cast(coalesce(b.chunk_index, o.chunk_index) as integer) as chunk_index, coalesce(b.content_hash, o.content_hash) as content_hash
from o full join b on o.repository_id = b.repository_id and o.commit_sha = b.commit_sha and o.chunk_index = b.chunk_index""")  # fmt: skip
def upsert_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk digests landed before March, overwritten by those landed later under one key."""
    keys = ["repository_id", "commit_sha", "chunk_index"]
    ids = table(spark, folder, "repositories").select("full_name", F.col("id").alias("repository_id")).distinct()
    rows = table(spark, folder, "repository_snapshots").where("indexed_commit_sha <> ''").join(ids, "full_name")
    rows = rows.select("repository_id", F.col("indexed_commit_sha").alias("commit_sha"), "landed_at", "snapshot_id", F.posexplode("code_chunks").alias("chunk_index", "chunk")).where("chunk <> ''")
    rows = rows.withColumn("content_hash", F.sha2("chunk", 256)).drop("chunk")
    cut = F.lit(CUT).cast("timestamp_ntz")
    old, new = (ingest.latest_per_key(rows.where(when), key=F.struct(*keys), at="landed_at", order="snapshot_id", first_on_ties=False).select(*keys, "content_hash") for when in (F.col("landed_at") < cut, F.col("landed_at") >= cut))
    return ingest.upsert(old, new, keys, ["content_hash"])


@R.query("insert_evidence", """with e as (select distinct r.id as repository_id, indexed_commit_sha as commit_sha, path from (select full_name, indexed_commit_sha, unnest(code_evidence_paths) as path from repository_snapshots where indexed_commit_sha <> '')
  join (select distinct id, full_name from repositories) r using (full_name))
select repository_id, commit_sha, path, case when contains(lower(path), 'test') then 'test' when contains(lower(path), 'example') or contains(lower(path), 'demo') then 'example' when regexp_matches(lower(path),
  '(pyproject\\.toml|requirements\\.txt|package\\.json|cargo\\.toml|go\\.mod)$') then 'dependency' else 'implementation' end as evidence_type, 0.8e0 as confidence from e""")  # fmt: skip
def insert_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of snapshots landed before March, then of all of them where it is absent."""
    snapshots, repositories = table(spark, folder, "repository_snapshots"), table(spark, folder, "repositories")
    early = snapshots.where(F.col("landed_at") < F.lit(CUT).cast("timestamp_ntz"))
    old, new = (codebase.evidence(codebase.indexed_snapshots(s, repositories)) for s in (early, snapshots))
    return ingest.insert_if_absent(old, new, ["repository_id", "commit_sha", "path", "evidence_type"], order="path").withColumn("confidence", F.lit(0.8))


@R.query("snapshot_replace", "select distinct full_name, strftime(data_watermark, '%Y-%m-%d') as run, case when data_watermark = (select max(data_watermark) from leaderboard_items) then 'again' else 'first' end as written from leaderboard_items")
def snapshot_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Both leaderboard runs written by run, the latest written again: it replaces its rows, the other run stays."""
    at = fresh(spark, "runs")
    rows = table(spark, folder, "leaderboard_items").select("full_name", F.date_format("data_watermark", "yyyy-MM-dd").alias("run")).distinct()
    ingest.replace_partitions(rows.withColumn("written", F.lit("first")), at, "run")
    last = rows.agg(F.max("run").alias("last"))
    ingest.replace_partitions(rows.join(F.broadcast(last)).where("run = last").drop("last").withColumn("written", F.lit("again")), at, "run")
    return spark.read.parquet(at).select("full_name", F.col("run").cast("string").alias("run"), "written")


@R.query("retention_delete", "select id from repository_observations where observed_at >= (select max(observed_at) from repository_observations) - interval 90 day")
def retention_delete(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.keep_recent(table(spark, folder, "repository_observations"), at="observed_at").select("id")


@R.query("retention_compact", """with m as (select max(observed_at) as m from repository_observations),
x as (select o.*, row_number() over (partition by repository_id, source, cast(observed_at as date), observed_at < m - interval 30 day and observed_at >= m - interval 90 day order by observed_at desc, id desc) as n,
  observed_at < m - interval 30 day and observed_at >= m - interval 90 day as between_ from repository_observations o, m)
select id from x where not between_ or n = 1""")  # fmt: skip
def retention_compact(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "repository_observations").select("id", *_OBS_KEYS)
    return ingest.compact(rows, ["repository_id", "source"], at="observed_at", order="id").select("id")


@R.query("previous_fallback", f"""with {_LATEST}, p as (select full_name, arg_max(indexed_commit_sha, snapshot_id) as sha, arg_max(symbol_count, snapshot_id) as symbols from repository_snapshots where indexed_commit_sha is not null group by full_name)
select full_name, coalesce(b.indexed_commit_sha, p.sha) as indexed_commit_sha, case when b.indexed_commit_sha is null and p.full_name is not null then p.symbols else b.symbol_count end as symbol_count from b left join p using (full_name)""")  # fmt: skip
def previous_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The latest snapshots; where one isn't indexed, the latest earlier analysis stands in."""
    rows = _batch(spark, folder).select("full_name", "indexed_commit_sha", "symbol_count")
    earlier = table(spark, folder, "repository_snapshots").where("indexed_commit_sha is not null").select("full_name", "snapshot_id", "indexed_commit_sha", "symbol_count")
    return jsonl.with_previous(rows, earlier, fields=["indexed_commit_sha", "symbol_count"], order="snapshot_id", missing="indexed_commit_sha")


@R.query("enrich_select", f"with {_LATEST} select full_name, stars from b order by stars desc, coalesce(pypi_downloads_30d, 0) desc, snapshot_id limit 50")
def enrich_select(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty repositories to analyse first: most stars, then most downloads."""
    order = [F.col("stars").desc(), F.coalesce("pypi_downloads_30d", F.lit(0)).desc(), F.col("snapshot_id").asc()]
    return _batch(spark, folder).orderBy(*order).limit(50).select("full_name", "stars")


@R.query("cache_missing", "select distinct sha256(text) as digest from documents where text is not null and text not in (select text from documents join embeddings on doc_id = vec_id where text is not null)")
def cache_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the texts for which no document has a vector."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = docs.join(table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return ingest.missing_from_cache(docs, known.select("digest").distinct(), digest="digest")


@R.query("text_vector_lookup", "select d.doc_id, e.vec_id, e.label from documents d join (select text, min(vec_id) as vec_id, arg_min(label, vec_id) as label from documents join embeddings on doc_id = vec_id where text is not null group by text) e on d.text = e.text")
def text_vector_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The cached vector of every text, looked up by digest; repeated texts share one."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id", "label")
    cache = docs.join(vectors, "doc_id").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.min_by("label", "vec_id").alias("label"))
    return docs.join(cache, "digest").select("doc_id", "vec_id", "label")


@R.query("union_inputs", "select lower(full_name) as repo, count(*) as n from (select full_name from repositories union all select full_name from repository_snapshots union all select full_name from leaderboard_items) group by 1")
def union_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Names of all three tables as one bag, counted regardless of case."""
    rows = [table(spark, folder, t).select("full_name") for t in ("repositories", "repository_snapshots", "leaderboard_items")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(F.lower("full_name").alias("repo")).agg(F.count("*").alias("n"))


@R.query("language_count", "select lower(coalesce(language, 'Unknown')) as language, count(distinct lower(full_name)) as repositories, count(distinct topic) as topics from (select language, full_name, unnest(case when len(topics) > 0 then topics else [null] end) as topic from repository_snapshots) group by 1")
def language_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "repository_snapshots").select(F.lower(F.coalesce("language", F.lit("Unknown"))).alias("language"), F.lower("full_name").alias("repo"), F.explode_outer("topics").alias("topic"))
    return rows.groupBy("language").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("topic").alias("topics"))


def _events(spark: SparkSession, folder: str) -> str:
    """The observations as landed event files."""
    names = leaderboard.unique_repositories(table(spark, folder, "repositories")).select(F.col("id").alias("repository_id"), "full_name")
    rows = table(spark, folder, "repository_observations").join(names, "repository_id")
    at = fresh(spark, "events")
    event = rows.select(F.lit("1").alias("schema_version"), F.col("id").cast("string").alias("event_id"), "source", F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured_at"), "full_name", F.concat(F.lit("https://code.example/"), "full_name").alias("html_url"))
    event.write.json(at)
    return at


@R.query("stream_ingest", "select full_name, source, count(distinct observed_at) as events from repository_observations o join (select distinct id as rid, full_name from repositories) r on r.rid = o.repository_id group by all")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events ingested by a stream, each key once."""
    at = fresh(spark, "ingested")
    streaming.ingest(streaming.read_events(spark, _events(spark, folder)), at, fresh(spark, "ingest-state"))
    return spark.read.parquet(at).groupBy("full_name", "source").agg(F.count("*").alias("events"))


@R.query("stream_daily_latest", """select strftime(observed_at, '%Y-%m-%d') as day, full_name, source, arg_max(cast(o.id as varchar), row(observed_at, cast(o.id as varchar))) as event_id, cast(count(*) as bigint) as events
  from repository_observations o join (select distinct id as rid, full_name from repositories) r on r.rid = o.repository_id where observed_at is not null and source is not null group by all""")  # fmt: skip
def stream_daily_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each repository, source and day, kept up by a stream."""
    at = fresh(spark, "daily")
    streaming.daily_latest(streaming.read_events(spark, _events(spark, folder)), at, fresh(spark, "daily-state"))
    return streaming.latest_days(spark, at).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
