"""Queries of source-code evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import codebase as c
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

R = Registry()

_PATHS = "ps as (select distinct full_name, unnest(code_evidence_paths) as path from repository_snapshots)"
_ENDS = "|".join(c.LANGUAGES)
_SKIP = "[" + ", ".join(f"'{x}'" for x in c.SKIPPED) + "]"
_SOURCE = f"(regexp_matches(lower(path), '[^/]\\.({_ENDS})$') and not list_has_any(string_split(lower(path), '/'), {_SKIP}))"
_PRIORITY = """case when list_contains(string_split(lower(path), '/'), 'test') or starts_with(string_split(lower(path), '/')[-1], 'test') then 0
  when list_has_any(string_split(lower(path), '/'), ['example', 'examples', 'demo', 'demos']) then 1 else 2 end, len(string_split(path, '/')), lower(path), path"""
_FILES = "f as (select full_name, path, arg_max(content, row(fetched_at, file_id)) as content from source_files where content is not null group by all)"
_SYM = c.SYMBOL
_IMP = c.IMPORT.replace("'", "''")
_NAMES = f"n as (select full_name, path, regexp_extract_all(content, '{_SYM}', 1) as symbols, regexp_extract_all(content, '{_IMP}', 1) as imports from f)"


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each evidence path of each repository, once."""
    return table(spark, folder, "repository_snapshots").select("full_name", F.explode("code_evidence_paths").alias("path")).distinct()


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """The latest content of each landed file."""
    rows = table(spark, folder, "source_files").where("content is not null")
    return rows.groupBy("full_name", "path").agg(F.max_by("content", F.struct("fetched_at", "file_id")).alias("content"))


@R.query("evidence_types", f"""with {_PATHS} select full_name, path, case when contains(lower(path), 'test') then 'test' when contains(lower(path), 'example') or contains(lower(path), 'demo') then 'example'
  when regexp_matches(lower(path), '(pyproject\\.toml|requirements\\.txt|package\\.json|cargo\\.toml|go\\.mod)$') then 'dependency' else 'implementation' end as evidence_type from ps""")  # fmt: skip
def evidence_types(spark: SparkSession, folder: str) -> DataFrame:
    return paths(spark, folder).withColumn("evidence_type", c.evidence_type(F.col("path")))


@R.query("source_paths", f"with {_PATHS} select full_name, path from ps where {_SOURCE}")
def source_paths(spark: SparkSession, folder: str) -> DataFrame:
    return paths(spark, folder).where(c.is_source(F.col("path")))


@R.query("file_priority", f"with {_PATHS} select full_name, path, row_number() over (partition by full_name order by {_PRIORITY}) as place from ps where {_SOURCE}")
def file_priority(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    p = F.col("path")
    rows = paths(spark, folder).where(c.is_source(p))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("full_name").orderBy(*c.priority(p))).cast("long"))


@R.query("file_budget", f"""with {_PATHS},
s as (select *, case when contains(lower(path), 'test') then 0 when list_has_any(string_split(lower(path), '/'), ['example', 'examples', 'demo', 'demos']) then 1 else 2 end as kind,
  row_number() over (partition by full_name order by {_PRIORITY}) as overall from ps where {_SOURCE}),
o as (select *, row_number() over (partition by full_name, kind order by overall) as own from s),
p as (select *, row_number() over (partition by full_name order by case when own <= case kind when 0 then 2 when 1 then 2 else 4 end then kind else 3 end, overall) as place from o)
select full_name, path, place from p where place <= 8""")  # fmt: skip
def file_budget(spark: SparkSession, folder: str) -> DataFrame:
    return c.select_files(paths(spark, folder)).withColumn("place", F.col("place").cast("long"))


@R.query("path_tallies", f"""with {_PATHS} select full_name, count(*) as sources, count(*) filter (where contains(lower(path), 'test')) as tests,
  count(*) filter (where regexp_matches(lower(path), 'example|demo')) as examples from ps where {_SOURCE} group by full_name""")  # fmt: skip
def path_tallies(spark: SparkSession, folder: str) -> DataFrame:
    return c.path_tallies(paths(spark, folder))


@R.query("symbols_imports", f"with {_FILES}, {_NAMES} select full_name, path, array_to_string(symbols, ' ') as symbols, array_to_string(imports, ' ') as imports from n")
def symbols_imports(spark: SparkSession, folder: str) -> DataFrame:
    return c.names(contents(spark, folder)).select("full_name", "path", *[F.array_join(x, " ").alias(x) for x in ("symbols", "imports")])


@R.query("python_names")
def python_names(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols and imports of Python files by their syntax tree."""
    return c.python_names(contents(spark, folder))


_STOP = ", ".join(f"'{x}'" for x in c.CODE_STOP_WORDS)
_TERMS = f"""t as (select full_name, path, i, lower(w[i]) as term from (select full_name, path, w, unnest(range(1, len(w) + 1)) as i from (select full_name, path,
  regexp_extract_all(array_to_string(list_concat(list_concat([path], symbols), imports), ' '), '{c.IDENTIFIER}') as w from n))),
k as (select full_name, term, count(*) as uses, min(row(path, i)) as seen from t where term not in ({_STOP}) group by all)"""


@R.query("code_terms", f"""with {_FILES}, {_NAMES}, {_TERMS}, r as (select *, row_number() over (partition by full_name order by uses desc, seen, term) as place from k)
select full_name, term, uses, place from r where place <= 60""")  # fmt: skip
def code_terms(spark: SparkSession, folder: str) -> DataFrame:
    return c.code_terms(contents(spark, folder)).withColumn("place", F.col("place").cast("long"))


@R.query("code_metrics", f"""with {_FILES}, {_NAMES}, {_TERMS},
s as (select full_name, count(distinct x) as symbols from (select full_name, unnest(symbols) as x from n) group by all), d as (select full_name, count(distinct x) as imports from (select full_name, unnest(imports) as x from n) group by all),
m as (select full_name, count(*) as terms from k group by all), b as (select full_name, count(*) as files, count(*) filter (where {_SOURCE}) as sources, count(*) filter (where {_SOURCE} and contains(lower(path), 'test')) as tests,
  count(*) filter (where {_SOURCE} and regexp_matches(lower(path), 'example|demo')) as examples from f group by all),
j as (select b.*, coalesce(symbols, 0) as symbols, coalesce(imports, 0) as imports, coalesce(terms, 0) as terms from b left join s using (full_name) left join d using (full_name) left join m using (full_name))
select *, round(least(1.0e0, tests / greatest(1, sources)::double * 4.0e0 + case when examples > 0 then 0.2e0 else 0.0e0 end), 6) as quality, round(least(1.0e0, symbols / greatest(10, files * 8)::double), 6) as depth,
  round(least(1.0e0, terms / 80.0e0), 6) as originality from j""")  # fmt: skip
def code_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = c.code_metrics(contents(spark, folder))
    for x in ("quality", "depth", "originality"):
        rows = rows.withColumn(x, F.round(x, 6))
    return rows


_DENIED = ", ".join(f"'{x}'" for x in c.DENIED_NAMES)
_FOLDERS = "[" + ", ".join(f"'{x}'" for x in c.DENIED_FOLDERS) + "]"
_MANIFESTS = ", ".join(f"'{x}'" for x in c.MANIFESTS[:5])


@R.query("safe_scan", f"""with {_FILES},
a as (select * from f where string_split(lower(path), '/')[-1] not in ({_DENIED}) and not starts_with(string_split(lower(path), '/')[-1], '.env') and not list_has_any(list_slice(string_split(path, '/'), 1, -2), {_FOLDERS})
  and (regexp_matches(lower(path), '[^/]\\.({_ENDS})$') or string_split(lower(path), '/')[-1] in ({_MANIFESTS})) and octet_length(encode(content)) <= 100000),
b as (select *, count(*) over w as read, coalesce(sum(octet_length(encode(content))) over w, 0) as consumed from a window w as (partition by full_name order by path rows between unbounded preceding and 1 preceding))
select full_name, path, regexp_matches(content, '{c.SECRET}') as secret from b where read < 5 and consumed < 6000""")  # fmt: skip
def safe_scan(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan of at most 5 files and 6,000 bytes a repository reads."""
    return c.scan(contents(spark, folder), max_files=5, max_bytes=6_000).select("full_name", "path", "secret")


@R.query("safe_scan_whole", R.sql["safe_scan"].replace("read < 5 and consumed < 6000", "read < 120 and consumed < 1000000"))
def safe_scan_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan within the operator's own limits, 120 files and 1,000,000 bytes a repository, reads."""
    return c.scan(contents(spark, folder)).select("full_name", "path", "secret")


_KNOWN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in c.LANGUAGES.items()) + "}"
_CAPPED = "list({v} order by {o})[1:100]"
#: The tables hold no manifests and no ignore files, so the SQL reads none; tests/test_code.py does.
_CONTEXT = f"""
r as (select full_name, path, content, regexp_matches(content, '{c.SECRET}') as secret from b where read < 120 and consumed < 1000000),
n as (select full_name, path, {_KNOWN}[regexp_extract(lower(path), '[^/]\\.([a-z]+)$', 1)] as language, regexp_extract_all(content, '{_SYM}', 1) as symbols, regexp_extract_all(content, '{_IMP}', 1) as imports from r where not secret),
l as (select full_name, list(language order by k desc, seen) as x from (select full_name, language, count(*) as k, min(path) as seen from n where language is not null group by all) group by all),
i as (select distinct full_name, d from (select full_name, unnest(imports) as d from n) where lower(d) not in ({', '.join(f"'{x}'" for x in c.NO_DEPENDENCY)})),
d as (select full_name, {_CAPPED.format(v='d', o='d')} as x from i group by all),
w as (select full_name, {_CAPPED.format(v='d', o='d')} as x from i where trim(lower(d), '@') in ({', '.join(f"'{x}'" for x in c.FRAMEWORKS)}) group by all),
y as (select full_name, {_CAPPED.format(v='s', o='seen, s')} as x from (select full_name, symbols[k] as s, min(row(path, k)) as seen from (select full_name, path, symbols, unnest(range(1, least(20, len(symbols)) + 1)) as k from n) group by all) group by all),
z as (select r.full_name, count(*) as files, coalesce(any_value(l.x), []) as languages, coalesce(any_value(d.x), []) as dependencies, coalesce(any_value(w.x), []) as frameworks, coalesce(any_value(y.x), []) as symbols
  from r left join l using (full_name) left join d using (full_name) left join w using (full_name) left join y using (full_name) group by r.full_name)
select full_name, files, array_to_string(languages, ' ') as languages, array_to_string(dependencies, ' ') as dependencies, array_to_string(frameworks, ' ') as frameworks, array_to_string(symbols, ' ') as symbols,
  'Local project with ' || files || ' safe files; primary languages: ' || array_to_string(languages[1:4], ', ') || '; dependencies: ' || array_to_string(dependencies[1:30], ', ') as summary from z"""


@R.query("project_context", R.sql["safe_scan"][: R.sql["safe_scan"].rindex("\nselect")] + "," + _CONTEXT)
def project_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of every repository as a project: what its files use, need and define."""
    rows = c.project_context(c.scan(contents(spark, folder)))
    return rows.select("full_name", "files", *[F.array_join(x, " ").alias(x) for x in ("languages", "dependencies", "frameworks", "symbols")], "summary")


@R.query("vectorize_chunks", """with s as (select r.id as repository_id, indexed_commit_sha as commit_sha, code_evidence_paths as p, case when len(code_chunks) > 0 then code_chunks else [architecture_summary] end as ch
  from repository_snapshots s join (select distinct id, full_name from repositories) r using (full_name) where indexed_commit_sha <> ''),
x as (select repository_id, commit_sha, p, unnest(range(0, len(ch))) as chunk_index, unnest(ch) as chunk from s)
select distinct repository_id, commit_sha, case when len(p) > 0 then p[least(chunk_index, len(p) - 1) + 1] else 'repository-summary' end as path, cast(chunk_index as integer) as chunk_index, sha256(chunk) as content_hash from x where chunk <> ''""")  # fmt: skip
def vectorize_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks to encode, with the digest by which a cache knows them."""
    rows = c.chunk_rows(c.indexed_snapshots(table(spark, folder, "repository_snapshots"), table(spark, folder, "repositories")))
    return rows.select("repository_id", "commit_sha", "path", "chunk_index", F.sha2("chunk", 256).alias("content_hash")).distinct()
