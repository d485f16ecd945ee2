"""Text expressions: tokens, a repository's text, queries made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the words that queries leave out.
TOKEN = r"[a-z0-9][a-z0-9_+.-]{1,}"
QUERY_STOP_WORDS = "the and for with from that this open source library framework".split()


def tokens(text: Column) -> Column:
    """All tokens of a text in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def repository_text() -> Column:
    """A snapshot's searchable text: its non-empty parts, joined by spaces."""
    joined = [F.array_join(c, " ") for c in ("topics", "code_terms", "code_evidence_paths")]
    parts = [F.replace("full_name", F.lit("/"), F.lit(" ")), F.col("description"), joined[0], F.coalesce("language", F.lit("Unknown")), joined[1], joined[2], F.col("architecture_summary")]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def query_terms() -> Column:
    """A snapshot's query: tokens of five topics, eight tokens of the description without stop words, the language; twelve distinct ones."""
    stop = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])
    topics = F.flatten(F.transform(F.slice("topics", 1, 5), tokens))
    description = F.slice(F.filter(tokens(F.col("description")), lambda x: ~F.array_contains(stop, x)), 1, 8)
    language = F.array(F.lower(F.coalesce("language", F.lit("Unknown"))))
    return F.slice(F.array_distinct(F.concat(F.coalesce(topics, F.array().cast("array<string>")), description, language)), 1, 12)


def owner_of(full_name: Column) -> Column:
    return F.substring_index(full_name, "/", 1)


def name_of(full_name: Column) -> Column:
    """What follows the first slash; the whole name if there is none."""
    return F.regexp_replace(full_name, r"^[^/]*/", "")


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))).cast("double")


def reason() -> Column:
    """Why a snapshot is shown: its first two topics and evidence paths."""
    # The wording of a reason.
    first = lambda c: F.array_join(F.slice(c, 1, 2), ", ")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    what = F.when(has("topics"), F.concat(F.lit("implements "), first("topics"))).otherwise("source-level capability match")
    return F.concat_ws("; ", what, F.when(has("code_evidence_paths"), F.concat(F.lit("verified in "), first("code_evidence_paths"))))
