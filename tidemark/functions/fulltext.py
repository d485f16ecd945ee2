"""English words by their stems, and searches in the syntax of web search engines, as columns and as SQL of the same steps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that searches leave out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

_WORD = "[a-z0-9]+"
_SOME = "^[^aeiouy]*[aeiouy]+[^aeiouy].*"  # a vowel and a consonant behind it
_MORE = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*"  # that twice
_SHORT = "^[^aeiouy]*[aeiouy][^aeiouywx]$"

# Porter's published steps, each a list of (condition on the word, ending, what replaces it); the first that holds is taken.
_STEPS = [
    [("", "sses$", "ss"), ("", "ies$", "i"), ("", "ss$", "ss"), (".{2,}", "s$", "")],
    [(_SOME + "eed$", "eed$", "ee"), ("eed$", "eed$", "eed"), ("[aeiouy].*(ed|ing)$", "(at|bl|iz)(ed|ing)$", "+1e"), ("[aeiouy].*(ed|ing)$", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)(ed|ing)$", "+half"), ("^[^aeiouy]*[aeiouy][^aeiouywx](ed|ing)$", "(ed|ing)$", "e"), ("[aeiouy].*(ed|ing)$", "(ed|ing)$", "")],
    [("[aeiouy].*y$", "y$", "i")],
    [(_SOME + f"{a}$", f"{a}$", b) for a, b in (
        ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
        ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    )],
    [(_SOME + f"{a}$", f"{a}$", b) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))],
    [(_MORE + f"{a}$", f"{b}$", "") for a, b in ((x, x) for x in "ement ment ance ence able ible ant ent ism ate iti ous ive ize al er ic ou".split())] + [("^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+.*[st]ion$", "ion$", "")],
    [(_MORE + "e$", "e$", ""), (_SHORT[:-1] + "e$", "e$", "e"), (_SOME + "e$", "e$", ""), (_MORE + "ll$", "ll$", "l")],
]


def _step(rules: list[tuple[str, str, str]], matches: str, shorter: str) -> str:
    """A step on the word x as SQL. matches and shorter: the dialect's forms of a match and of a text without its last letter."""
    endings = "|".join(dict.fromkeys(e.removesuffix("$") for _, e, _ in rules))
    cases = [f"when length(x) <= 2 or not {matches.format('(' + endings + ')$')} then x"]  # most words pass a step by one look
    bare = "regexp_replace(x, '(ed|ing)$', '')"
    for condition, ending, by in rules:
        holds = " and ".join(matches.format(p) for p in (condition, ending) if p)
        value = f"concat({bare}, 'e')" if by == "+1e" else shorter.format(bare) if by == "+half" else f"regexp_replace(x, '{ending}', '{by}')"
        cases.append(f"when {holds} then {value}")
    return "case " + " ".join(cases) + " else x end"


def stems(text: str) -> Column:
    """The stems of the words of a text, given as a SQL expression, in their order and without stop words; none for null."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = f"filter(regexp_extract_all(lower(coalesce({text}, '')), '{_WORD}', 0), x -> x not in ({stop}))"
    for rules in _STEPS:
        step = _step(rules, "rlike(x, '{}')", "substring({0}, 1, length({0}) - 1)")
        out = f"transform({out}, x -> {step})"
    return F.expr(out)


def stems_sql(text: str) -> str:
    """The same for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    out = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{_WORD}'), lambda x: x not in ({stop}))"
    for rules in _STEPS:
        step = _step(rules, "regexp_matches(x, '{}')", "{}[:-2]")
        out = f"list_transform({out}, lambda x: {step})"
    return out


@dataclass(frozen=True)
class Term:
    """Words that must stand, in succession if there are several, or must not."""

    words: str
    excluded: bool


def parsed(query: str) -> list[list[Term]]:
    """The alternatives of a search, each a list of terms that must all hold: quoted words are one term, `-` excludes the next
    one, `or` parts alternatives; other words must all stand. Terms of stop words alone are left out."""
    options: list[list[Term]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            options.append([])
            continue
        words = [w for w in re.findall(_WORD, quoted or word) if w not in STOP_WORDS]
        if words:
            options[-1].append(Term(" ".join(words), bool(minus)))
    return [o for o in options if o]
