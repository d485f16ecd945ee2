"""What is shown of a result: labels, percentages, movements, lines of text, page numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of a status by its name on the command line.
STATUS = {"emerging": "Emerging", "durable": "Durable", "hidden-gem": "Hidden gem", "overhyped": "Overhyped", "at-risk": "At risk"}


def rounded(x: Column) -> Column:
    """The nearest whole number, halves upwards."""
    return F.floor(x + 0.5)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(x: Column) -> Column:
    return rounded(clamped(x) * 100.0)


def adoption_label(probability: Column) -> Column:
    p = clamped(probability)
    return F.when(probability.isNull(), "Unscored").when(p >= 0.7, "Emerging").when(p >= 0.5, "Durable").otherwise("Hidden gem")


def spark_tail(probability: Column) -> Column:
    """The last point of a growth line."""
    return rounded(80.0 + 20.0 * F.when(probability.isNull(), 0.5).otherwise(clamped(probability)))


def match_score(score: Column) -> Column:
    return rounded(70.0 + 29.0 / (1.0 + F.exp(-score)))


def compare_bucket(match: Column) -> Column:
    return F.when(match >= 90, "Strong").when(match >= 80, "Good").otherwise("Partial")


def preview_score(match: Column, texts: list[Column], query: str) -> Column:
    """A match moved by the share of the query's words of three letters or more that the texts hold."""
    words = F.filter(F.split(F.lower(F.lit(query)), r"\W+"), lambda w: F.length(w) > 2)
    text = F.lower(F.concat_ws(" ", *texts))
    share = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.greatest(F.lit(1), F.size(words))
    return F.least(F.lit(99), rounded(match - 5 + share * 14.0))


def movement(delta: Column, gap: str = "") -> Column:
    return F.when(delta.isNull(), "new").when(delta > 0, F.concat(F.lit("↑" + gap), delta)).when(delta < 0, F.concat(F.lit("↓" + gap), F.abs(delta))).otherwise("—")


def compact_number(n: Column) -> Column:
    """A whole number with its unit and at most one digit behind the point from 10,000 on, otherwise with separators of thousands."""

    def unit(power: int, name: str) -> Column:
        tenths = F.floor(n / float(10 ** (power - 1)) + 0.5)
        return F.concat(F.floor(tenths / 10), F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), tenths % 10)), F.lit(name))

    return F.when(n < 10_000, F.format_number(n, 0)).when(n < 999_950, unit(3, "K")).when(n < 999_950_000, unit(6, "M")).otherwise(unit(9, "B"))


def result_line(rank: str, name: str, score: str, status: str, delta: str, url: str) -> Column:
    share = F.format_string("%5.1f", F.col(score) * 100.0)
    return F.concat(F.lpad(F.col(rank).cast("string"), F.greatest(F.lit(4), F.length(F.col(rank).cast("string"))), F.lit("0")), F.lit(" "), F.col(name), F.lit("  "), share, F.lit("  "), F.col(status), F.lit("  "), movement(F.col(delta)), F.lit("\n     "), F.col(url))


def total_pages(total: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / limit))


def page_offset(page: int, limit: int) -> int:
    return (page - 1) * limit


def toggled(chosen: Column, name: Column, most: int = 3) -> Column:
    """A choice of names without the given one if it is in it, with it if there is room."""
    return F.when(F.array_contains(chosen, name), F.array_remove(chosen, name)).when(F.size(chosen) < most, F.array_append(chosen, name)).otherwise(chosen)


def page_request(*, status: str | None = None, page: int = 1, limit: int = 25, **filters: str | int | None) -> dict[str, str | int]:
    """The parameters of a request for a page: the status by its label, page and limit within their bounds, nothing that is null."""
    wanted = filters | {"status": STATUS.get(status or ""), "page": max(1, page), "limit": max(5, min(50, limit))}
    return {k: v for k, v in wanted.items() if v is not None}


def checked_query(text: str, limit: int = 10) -> tuple[str, int]:
    """A search's text without white space around it, and its limit; a text of less than 2 or more than 500 signs, or a limit out of 1 to 25, fails."""
    text = text.strip()
    if not 2 <= len(text) <= 500 or not 1 <= limit <= 25:
        raise ValueError("a query has 2 to 500 signs and a limit of 1 to 25")
    return text, limit
