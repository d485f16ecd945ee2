"""Evidence from source code: path rules, file selection, symbols, imports, terms, and a bounded safe scan."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Languages by the ending of a source file.
LANGUAGES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java",
    "kt": "kotlin", "swift": "swift", "rb": "ruby", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c",
}
# Folders whose files are no sources of the project.
SKIPPED = ["node_modules", "vendor", "dist", "build", ".venv", "venv", "target", "generated"]
# Names of dependency manifests.
MANIFESTS = ["pyproject.toml", "requirements.txt", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "gemfile"]
# Words of code that say nothing of a project.
CODE_STOP_WORDS = "const return self this from import class function public private string number true false none async await with that tests test".split()
# Names and folders that a scan never opens, and what gives away a secret.
DENIED_NAMES = [".env", ".npmrc", ".pypirc", "credentials", "credentials.json", "id_rsa", "id_ed25519"]
DENIED_FOLDERS = [".git", ".venv", "venv", "node_modules", "dist", "build", "target", ".next", "vendor"]
SECRET = r"(?i)(?:api[_-]?key|secret|password|token|private[_-]?key)\s*[:=]"
# Framework names; patterns of symbols, imports and identifiers.
FRAMEWORKS = ["next", "react", "fastapi", "django", "flask", "torch", "tensorflow", "spark", "kafka", "redis"]
SYMBOL = r"(?:def|class|function|fn|func|interface|struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT = r"(?:import|from|require\s*\(|use|package)\s*[('\"]?([A-Za-z0-9_@./:-]+)"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{2,}"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def base(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def is_source(path: Column) -> Column:
    return F.lower(path).rlike(r"[^/]\.(?:" + "|".join(LANGUAGES) + ")$") & ~F.arrays_overlap(parts(path), _strings(SKIPPED))


def language_of(path: Column) -> Column:
    ending = F.regexp_extract(F.lower(path), r"[^/]\.([a-z]+)$", 1)
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[ending]


def is_test(path: Column) -> Column:
    return F.contains(F.lower(path), F.lit("test"))


def is_example(path: Column) -> Column:
    return F.lower(path).rlike("example|demo")


def evidence_type(path: Column) -> Column:
    manifest = F.lower(path).rlike(r"(?:pyproject\.toml|requirements\.txt|package\.json|cargo\.toml|go\.mod)$")
    return F.when(is_test(path), "test").when(is_example(path), "example").when(manifest, "dependency").otherwise("implementation")


def priority(path: Column) -> list[Column]:
    """Sort columns: tests, then examples, then the rest; shallow paths first; then by name."""
    test = F.array_contains(parts(path), "test") | base(path).startswith("test")
    example = F.arrays_overlap(parts(path), _strings(["example", "examples", "demo", "demos"]))
    return [F.when(test, 0).when(example, 1).otherwise(2), F.size(parts(path)) - 1, F.lower(path), path]


# Indexed snapshots ---------------------------------------------------------------------------------------------------


def indexed_snapshots(snapshots: DataFrame, repositories: DataFrame) -> DataFrame:
    """Snapshots with a commit, of repositories known by their exact name."""
    ids = repositories.select("full_name", F.col("id").alias("repository_id")).distinct()
    return snapshots.where("indexed_commit_sha <> ''").join(ids, "full_name").select("repository_id", "indexed_commit_sha", "code_evidence_paths", "code_chunks", "architecture_summary")


def evidence(indexed: DataFrame) -> DataFrame:
    """(repository_id, commit_sha, path, evidence_type), each path of a commit once."""
    rows = indexed.select("repository_id", F.col("indexed_commit_sha").alias("commit_sha"), F.explode("code_evidence_paths").alias("path")).distinct()
    return rows.withColumn("evidence_type", evidence_type(F.col("path")))


def chunk_rows(indexed: DataFrame) -> DataFrame:
    """(repository_id, commit_sha, path, chunk_index, chunk): a snapshot's chunks, or its summary if it has none; empty ones drop out.

    A chunk goes with the evidence path at its place, the last one if there are fewer, `repository-summary` if there are none.
    """
    chunks = F.when(F.size("code_chunks") > 0, F.col("code_chunks")).otherwise(F.array("architecture_summary"))
    rows = indexed.select("repository_id", F.col("indexed_commit_sha").alias("commit_sha"), "code_evidence_paths", F.posexplode(chunks).alias("chunk_index", "chunk")).where("chunk <> ''")
    place = F.least(F.col("chunk_index"), F.size("code_evidence_paths") - 1)
    path = F.when(F.size("code_evidence_paths") > 0, F.get("code_evidence_paths", place)).otherwise("repository-summary")
    return rows.select("repository_id", "commit_sha", path.alias("path"), "chunk_index", "chunk")


def chunk_counts(indexed: DataFrame) -> DataFrame:
    """(repository_id, vector_count): chunks over all commits, each place of a commit once."""
    rows = indexed.select("repository_id", "indexed_commit_sha", F.posexplode("code_chunks").alias("k", "chunk")).where("chunk <> ''")
    return rows.select("repository_id", "indexed_commit_sha", "k").distinct().groupBy("repository_id").agg(F.count("*").alias("vector_count"))


# Selection -----------------------------------------------------------------------------------------------------------


def select_files(paths: DataFrame, *, group: str = "full_name", budget: int = 8) -> DataFrame:
    """(group, path, place): the files of each group to read: at most two tests, two examples and `budget` - 4 others, filled up
    to the budget by priority, and two manifests besides."""
    p = F.col("path")
    unique = paths.select(group, "path").distinct()
    sources = unique.where(is_source(p))
    kind = F.when(is_test(p), 0).when(F.arrays_overlap(parts(p), _strings(["example", "examples", "demo", "demos"])), 1).otherwise(2)
    caps = F.element_at(F.array(F.lit(min(2, budget)), F.lit(min(2, max(0, budget - 2))), F.lit(max(0, budget - 4))), F.col("kind") + 1)
    ranked = sources.withColumn("kind", kind).withColumn("overall", F.row_number().over(Window.partitionBy(group).orderBy(*priority(p))))
    ranked = ranked.withColumn("own", F.row_number().over(Window.partitionBy(group, "kind").orderBy("overall")))
    first = F.when(F.col("own") <= caps, F.col("kind")).otherwise(3)
    chosen = ranked.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(first, "overall"))).where(F.col("place") <= budget)
    manifests = unique.where(base(p).isin(MANIFESTS)).withColumn("place", budget + F.row_number().over(Window.partitionBy(group).orderBy("path"))).where(F.col("place") <= budget + 2)
    return chosen.select(group, "path", "place").unionByName(manifests)


def path_tallies(paths: DataFrame, *, group: str = "full_name") -> DataFrame:
    p = F.col("path")
    rows = paths.select(group, "path").distinct().where(is_source(p))
    return rows.groupBy(group).agg(F.count("*").alias("sources"), F.count(F.when(is_test(p), 1)).alias("tests"), F.count(F.when(is_example(p), 1)).alias("examples"))


# Symbols -------------------------------------------------------------------------------------------------------------


def names(files: DataFrame, *, keep: tuple[str, ...] = ("full_name", "path")) -> DataFrame:
    """Add the arrays `symbols` and `imports` that the patterns find in `content`."""
    found = lambda pattern: F.coalesce(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    return files.select(*keep, found(SYMBOL).alias("symbols"), found(IMPORT).alias("imports"))


def python_names(files: DataFrame) -> DataFrame:
    """(full_name, path, symbols, imports) of Python files by their syntax tree; files that don't parse have empty ones."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            symbols, imports = [], []
            for text in b["content"]:
                s, d = [], []
                try:
                    for node in ast.walk(ast.parse(text or "")):
                        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                            s.append(node.name)
                        elif isinstance(node, ast.Import):
                            d += [a.name.split(".")[0] for a in node.names]
                        elif isinstance(node, ast.ImportFrom) and node.module:
                            d.append(node.module.split(".")[0])
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    s, d = [], []
                symbols.append(s)
                imports.append(d)
            yield b[["full_name", "path"]].assign(symbols=symbols, imports=imports)

    rows = files.where(F.lower("path").endswith(".py")).select("full_name", "path", "content")
    return rows.mapInPandas(parse, "full_name string, path string, symbols array<string>, imports array<string>")


def code_terms(files: DataFrame, *, top: int = 60) -> DataFrame:
    """(full_name, term, uses, place): each repository's most used identifiers among paths, symbols and imports; ties go to the one first seen."""
    line = F.array_join(F.concat(F.array("path"), "symbols", "imports"), " ")
    tokens = names(files).select("full_name", "path", F.posexplode(F.regexp_extract_all(line, F.lit(IDENTIFIER), F.lit(0))).alias("pos", "term"))
    tokens = tokens.withColumn("term", F.lower("term")).where(~F.col("term").isin(CODE_STOP_WORDS))
    counts = tokens.groupBy("full_name", "term").agg(F.count("*").alias("uses"), F.min(F.struct("path", "pos")).alias("seen"))
    place = F.row_number().over(Window.partitionBy("full_name").orderBy(F.col("uses").desc(), "seen", "term"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("full_name", "term", "uses", "place")


def code_metrics(files: DataFrame) -> DataFrame:
    """Per repository: files, distinct symbols and imports, distinct terms, and the source-level quality, depth and originality.

    Distinct counts are taken over exploded names, so no repository's names are gathered in one array.
    """
    rows = names(files)
    counts = rows.groupBy("full_name").agg(F.count("*").alias("files"))
    distinct = lambda c: rows.select("full_name", F.explode(c).alias("x")).distinct().groupBy("full_name").agg(F.count("*").alias(c))
    terms = code_terms(files, top=2**31 - 1).groupBy("full_name").agg(F.count("*").alias("terms"))
    out = counts.join(path_tallies(files), "full_name", "left")
    for part in (distinct("symbols"), distinct("imports"), terms):
        out = out.join(part, "full_name", "left")
    out = out.fillna(0)
    one = lambda c: F.least(F.lit(1.0), c)
    return out.select(
        "*",
        one(F.col("tests") / F.greatest(F.lit(1), F.col("sources")) * 4.0 + F.when(F.col("examples") > 0, 0.2).otherwise(0.0)).alias("quality"),
        one(F.col("symbols") / F.greatest(F.lit(10), F.col("files") * 8)).alias("depth"),
        one(F.col("terms") / 80.0).alias("originality"),
    )


# Safe scan -----------------------------------------------------------------------------------------------------------


def ignore_regex(line: str) -> tuple[str, bool] | None:
    """The regular expression of a line of an ignore file, over paths of which those of folders end in `/`, and whether it
    takes paths back in; None for lines that say nothing."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    if not line:
        return None
    tokens = re.findall(r"\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|.", line)
    known = {"**/": "(?:.*/)?", "/**": "/.+", "?": "[^/]"}
    body = "".join(known.get(t) or ("[^/]*" if t[0] == "*" else "[" + ("^" if t[1] == "!" else "") + t[1 + (t[1] == "!") : -1].replace("\\", "\\\\") + "]" if t[0] == "[" and len(t) > 1 else re.escape(t[-1])) for t in tokens)
    return ("^" if anchored else "^(?:.*/)?") + body + ("/$" if folder else "/?$"), back


def ignored(files: DataFrame, *, group: str = "full_name") -> DataFrame:
    """(group, path): the files that the ignore file at their group's root leaves out.

    Of the lines that match a path the last decides; a file in an ignored folder is ignored whatever later lines say of it.
    Lines meet only the paths of their own group, exploded into folders and file.
    """

    def translate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, i, *r) for g, text in zip(b["g"], b["content"], strict=True) for i, line in enumerate(text.split("\n")) if (r := ignore_regex(line))]
            yield pd.DataFrame(rows, columns=["g", "line", "regex", "back"])

    roots = files.where("path = '.gitignore' and content is not null").select(F.col(group).alias("g"), "content")
    lines = roots.mapInPandas(translate, "g string, line int, regex string, back boolean")
    split = F.split("path", "/")
    part = F.transform(F.sequence(F.lit(1), F.size(split)), lambda n: F.concat(F.array_join(F.slice(split, 1, n), "/"), F.when(n < F.size(split), "/").otherwise("")))
    parts_ = files.select(F.col(group).alias("g"), "path", F.explode(part).alias("part"))
    hits = parts_.join(lines, "g").where(F.expr("part rlike regex"))
    last = hits.groupBy("g", "path", "part").agg(F.max_by("back", "line").alias("back")).where("not back")
    return last.select(F.col("g").alias(group), "path").distinct()


def scan(files: DataFrame, *, group: str = "full_name", max_files: int = 120, max_bytes: int = 1_000_000) -> DataFrame:
    """The files of each group that a bounded scan reads, in order of path, with `secret` for those it then leaves aside.

    Denied names and folders, files that the group's ignore file leaves out, files that are neither sources nor manifests, and
    files over 100 kB are never opened. Reading stops once the files before hold `max_files` or `max_bytes`.
    """
    p, size = F.col("path"), F.octet_length("content")
    allowed = ~base(p).isin(DENIED_NAMES) & ~base(p).startswith(".env") & ~F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.lit(0), F.size(F.split(p, "/")) - 1)), _strings(DENIED_FOLDERS))
    known = language_of(p).isNotNull() | base(p).isin(MANIFESTS[:5])
    rows = files.where(F.col("content").isNotNull() & allowed & known & (size <= 100_000)).join(ignored(files, group=group), [group, "path"], "left_anti")
    before = Window.partitionBy(group).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("read", F.count("*").over(before)).withColumn("consumed", F.coalesce(F.sum(size).over(before), F.lit(0)))
    rows = rows.where((F.col("read") < max_files) & (F.col("consumed") < max_bytes))
    return rows.select(group, "path", "content", language_of(p).alias("language"), F.col("content").rlike(SECRET).alias("secret"))


def declared(files: DataFrame, *, group: str = "full_name") -> DataFrame:
    """(group, dependency): what the manifests of each group declare, as written; a broken manifest declares nothing.

    package.json: the names of dependencies and devDependencies; pyproject.toml: the project's dependencies up to a space or
    `>=`; requirements.txt: its lines up to `==` or `>=`.
    """
    name, text = F.element_at(F.split("path", "/"), -1), F.col("content")
    empty = F.array().cast("array<string>")
    package = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = lambda c: F.coalesce(F.map_keys(package[c]), empty)
    project = F.regexp_extract(text, r"(?ms)^\s*\[project\][^\n]*$(.*?)(?=^\s*\[|\z)", 1)
    listed = F.regexp_extract(project, r"""(?ms)^\s*dependencies\s*=\s*\[((?:[^\]"'#]|#[^\n]*|"[^"]*"|'[^']*')*)\]""", 1)
    strings = F.transform(F.regexp_extract_all(F.regexp_replace(listed, r"(?m)^\s*#.*$", ""), F.lit("\"[^\"]*\"|'[^']*'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    before = lambda x, mark: F.element_at(F.split(x, mark), 1)
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: (x != "") & ~x.startswith("#"))
    found = (
        F.when(name == "package.json", F.concat(keys("dependencies"), keys("devDependencies")))
        .when(name == "pyproject.toml", F.transform(strings, lambda x: before(before(x, " "), ">=")))
        .when(name == "requirements.txt", F.transform(lines, lambda x: F.trim(before(before(x, "=="), ">="))))
    )
    return files.where(name.isin("package.json", "pyproject.toml", "requirements.txt")).select(group, F.explode(found).alias("dependency")).distinct()


#: Words that patterns take for imports.
NO_DEPENDENCY = ["from", "import", "include", "require", "use"]


def project_context(scanned: DataFrame, *, group: str = "full_name") -> DataFrame:
    """(group, files, languages, dependencies, frameworks, symbols, summary) of what a scan read.

    Files with secrets count, but nothing is taken from them. Languages come by use, then by first path; dependencies are
    imports and what manifests declare, in alphabetical order, the first 100; frameworks those of all of them with a known
    name; symbols the first 20 of each file in the order of paths, each once, the first 100. The summary names four languages
    and thirty dependencies.
    """
    kept = scanned.where("not secret")
    empty = F.array().cast("array<string>")
    use = kept.where("language is not null").groupBy(group, "language").agg(F.count("*").alias("n"), F.min("path").alias("seen"))
    languages = use.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "language"))).alias("x")).select(group, F.transform("x", lambda x: x["language"]).alias("languages"))
    found = names(kept.where("language is not null"), keep=(group, "path"))
    imported = found.select(group, F.explode("imports").alias("dependency")).where(~F.lower("dependency").isin(NO_DEPENDENCY))
    needed = imported.unionByName(declared(kept, group=group)).distinct()

    def first(values: DataFrame, order: list[str], name: str, value: str) -> DataFrame:
        best = values.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("k <= 100")
        return best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", value))).alias("x")).select(group, F.transform("x", lambda x: x[value]).alias(name))

    frameworks = needed.where(F.trim(F.lower("dependency"), F.lit("@")).isin(FRAMEWORKS))
    symbols = found.select(group, "path", F.posexplode(F.slice("symbols", 1, 20)).alias("pos", "symbol")).groupBy(group, "symbol").agg(F.min(F.struct("path", "pos")).alias("seen"))
    parts_ = (languages, first(needed, ["dependency"], "dependencies", "dependency"), first(frameworks, ["dependency"], "frameworks", "dependency"), first(symbols, ["seen", "symbol"], "symbols", "symbol"))
    out = scanned.groupBy(group).agg(F.count("*").alias("files"))
    for part in parts_:
        out = out.join(part, group, "left")
    out = out.select(group, "files", *[F.coalesce(c, empty).alias(c) for c in ("languages", "dependencies", "frameworks", "symbols")])
    top = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    # The wording of a summary.
    summary = F.concat(F.lit("Local project with "), F.col("files"), F.lit(" safe files; primary languages: "), top("languages", 4), F.lit("; dependencies: "), top("dependencies", 30))
    return out.withColumn("summary", summary)


def context_text(context: DataFrame, *, group: str = "full_name") -> DataFrame:
    """(group, context): a project's context as the words that a search adds to its query."""
    parts_ = [F.array_join(F.col(c), " ") for c in ("languages", "frameworks", "dependencies", "symbols")]
    return context.select(group, F.concat_ws(" ", F.lit("Project context:"), *parts_, "summary").alias("context"))
