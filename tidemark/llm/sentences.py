"""Sentences of documents in any language and script, with their positions.

Two passes over the corpus. The first counts, for each word written with a period, what follows it: a small letter or a comma
(it can't end a sentence there), a digit, a capital, or the end of a block (it must). Those counts are shuffled by word and
summed, and give the words that are abbreviations, and which of these may end a sentence. The second cuts each document:
unambiguous occurrences in the document itself decide first, the corpus second, a short fixed list where both are silent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread

#: Characters of a text up to which a search may show that a word isn't used twice, before uses are counted; same answers.
SHORT = 20_000
#: Abbreviations up to which the table of corpus verdicts is broadcast; beyond it verdicts are joined to the documents.
MAX_BROADCAST = 200_000
#: Uses with a period from which the corpus has a verdict on a word: on few uses a clear one is needed, on many a plain one.
FEW, MANY = 8, 40
#: Share of an abbreviation's uses that stand before a small letter, at least, by few and by many uses; below the last an ordinary word's.
MID_FEW, MID_MANY, MID_ORDINARY = 0.5, 0.12, 0.06
#: Uses without a period for each with one, at most, of an abbreviation known only by never being last.
PLAIN_SHARE = 0.5
#: Share of uses at block ends, at most, of an abbreviation that never ends a sentence.
LAST_SHARE = 0.02

# Common abbreviations that don't end a sentence, and some that may.
NEVER_LAST = frozenset(
    "dr mr mrs ms prof st vs cf no nos nr vol pp p fig eq sec ch rev max min approx ca e.g i.e viz al "
    "z b d h u a bzw vgl abschn str hr frau m mme mlle ex env art n núm pág sr sra srta ee aprox ej "
    "т е г др см рис стр гл тыс им ул βλ π.χ σελ αρ डॉ श्री".split()
)
MAY_BE_LAST = frozenset("etc usw inc ltd co corp jr u.s p.m a.m uu κ.λπ κ.τ.λ д с".split())
# German words after which a whole number with a period is a day.
ORDINAL_BEFORE = frozenset("am vom zum bis der dem den des die ab seit im".split())

_LINE = regex.compile(r"[^\r\n]*(?:\r\n?|\n|\Z)")
_LEADS = frozenset("`~#-*+•>0123456789")
_FENCE = regex.compile(r"\s*(?:>\s?)*(`{3,}|~{3,})")
_HEADING = regex.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_BULLET = regex.compile(r"\s*[-*+•]\s")
_NUMBER = regex.compile(r"\s*(\d{1,9})[.)]\s")
_QUOTED = regex.compile(r"\s*>")
_OPENING = regex.compile(r"\s*(?:(?:[-*+•]|#{1,6}|\d{1,9}[.)]|>)(?:\s+|(?<=>)))*")
_MARKS = regex.compile(r"(?:[!?…。！？｡؟।॥۔]|\.(?![A-Za-z0-9/_]))[.!?…。！？｡؟।॥۔;;]*")
_MARKS_GREEK = regex.compile(r"(?:[!?…。！？｡؟।॥۔;;]|\.(?![A-Za-z0-9/_]))[.!?…。！？｡؟।॥۔;;]*")
_WIDE = frozenset("。！？｡")
_OTHER = frozenset("؟।॥۔")
_CLOSERS = "\"'”’»›)\\]}」』）】〉》*_‬‎‏️"
_MAY_CLOSE = frozenset(_CLOSERS + "“‘")
_CLOSING = regex.compile(rf"[{_CLOSERS}]*")
_CLOSING_DE = regex.compile(rf"[{_CLOSERS}“‘]*")
_FRENCH = regex.compile(r"[ \t\xa0  ]+»")
_EMOJI = regex.compile(r"\s*(?:\p{RI}\p{RI}|[\p{Extended_Pictographic}--[0-9#*©®™]][️‍\p{EMod}\p{Extended_Pictographic}]*)+", regex.V1)
_MAY_BE_EMOJI = regex.compile(r"\s*[\u203c-\u3299\U0001f000-\U0001fbff]")
_SKIP = regex.compile(r"(?:\s|​|(?<=[\r\n])\s*>)*")
_INNER = regex.compile(r"[\s​‪-‮\"'“”„‘«»‹›(\[{「『（【¿¡*_`>]*")
_BREAKS = frozenset(" \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u202f\u3000\u200b([{\"'“”„«»（「")
_ABBREVIATED = regex.compile(r"\p{L}{1,3}(?:\.\p{L}{1,3})+\Z")
_WORD = regex.compile(r"[\p{L}\p{M}.]*\p{L}[\p{L}\p{M}]*\Z")
_RUN = regex.compile(r"[\p{L}\p{M}.]*+\Z")
_MAY_LEAD = frozenset(".\ufe0f")
_GREEK = regex.compile(r"[Ͱ-ͽͿ-Ͽἀ-῿]")
_THAI = regex.compile(r"(?<=[\u0e00-\u0e7f])[\s\u200b]++(?=[\u0e00-\u0e7f])")
_CJK = regex.compile(r"[぀-ヿ㐀-鿿＀-￯]")
_PLAIN = regex.compile(r"(?<![\p{L}\p{M}.])[\p{L}\p{M}]++(?!\.)")
_NAMED = regex.compile(r"\p{Ll},?[ \n]((?:\p{Lu}|\p{Lt})[\p{L}\p{M}]*)")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_BEFORE = regex.compile(r"(\p{L}+)[\s\u200b>]+\Z")
_QUOTES = frozenset("\"'”’»›」』“‘")
_OPENERS = "\"'“„‘«‹「『"
_PARTICLES = tuple("とってはがもをにので")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, fenced) of the units in which sentences lie: paragraphs, headings, list entries, quotes, fenced blocks."""
    start, kind, number, fence = -1, "", 0, ""
    for m in _LINE.finditer(text):
        a, z = m.span()
        if a == z:
            break
        line = m.group()
        if fence:
            s = line.lstrip(" \t>")
            if s.startswith(fence) and not s.strip().strip(fence[0]):
                yield start, z, True
                start, kind, fence = -1, "", ""
            continue
        if not line.strip():
            if start >= 0:
                yield start, a, False
            start, kind = -1, ""
            continue
        lead = line.lstrip()[0]
        if lead not in _LEADS and not lead.isdigit():  # nothing but text
            if start < 0:
                start, kind = a, "plain"
            continue
        if f := _FENCE.match(line):
            if start >= 0:
                yield start, a, False
            start, fence = a, f.group(1)
            continue
        if _HEADING.match(line):
            if start >= 0:
                yield start, a, False
            yield a, z, False
            start, kind = -1, ""
            continue
        new = ""
        if _BULLET.match(line):
            new = "bullet"
        elif (n := _NUMBER.match(line)) and (start < 0 or kind == "number" and int(n.group(1)) == number + 1 or kind == "bullet" and int(n.group(1)) == 1):
            new, number = "number", int(n.group(1))
        elif _QUOTED.match(line) and (kind != "quote" or not line.strip(" \t\r\n>")):
            new = "quote"
        if new or start < 0:
            if start >= 0:
                yield start, a, False
            start, kind = a, new or "plain"
    if start >= 0:
        yield start, len(text), bool(fence)


def _next_kind(text: str, at: int, end: int) -> str:
    """What the text goes on with: L a small letter, U a capital, D a digit, O other letters and signs, - a dash, E nothing."""
    if at < end - 1 and text[at] == " " and text[at + 1].isalnum():
        at += 1
    else:
        at = _SKIP.match(text, at, end).end()
        if at >= end:
            return "E"
    if text[at] in "—–":
        return "-"
    if not text[at].isalnum():
        at = _INNER.match(text, at, end).end()
        if at >= end:
            return "O"
    c = text[at]
    return "L" if c.islower() else "U" if c.isupper() or c.istitle() else "D" if c.isdigit() else "O"


def _token(text: str, start: int, at: int) -> str:
    """What stands before a place, back to white space, a bracket or a quotation mark."""
    first, i = max(start, at - 40), at
    while i > first and text[i - 1] not in _BREAKS:
        i -= 1
    return text[i:at]


def period_uses(text: str) -> Iterator[tuple[str, str]]:
    """(word in lower case, what follows) for each use of a word with a single period; M for a comma or the like right behind."""
    for a, z, fenced in blocks(text):
        if fenced:
            continue
        for m in _MARKS.finditer(text, _OPENING.match(text, a, z).end(), z):
            e = m.end()
            if m.group() != ".":
                continue
            if e < z and not text[e].isspace():
                if text[e] in ",:;)":
                    kind = "L"
                else:
                    continue
            else:
                kind = _next_kind(text, e, z)
            w = _token(text, a, m.start()).lower()
            if w and (w.isalpha() or _WORD.match(w)):
                yield w, kind


def asked_words(text: str) -> set[str]:
    """All words in lower case whose verdict `sentences` may ask for, wherever a sentence before them ends."""
    found = set()
    for a, z, fenced in blocks(text):
        if fenced:
            continue
        for m in _MARKS.finditer(text, _OPENING.match(text, a, z).end(), z):
            if m.group() != ".":
                continue
            w = _RUN.search(_token(text, a, m.start())).group()
            while w:
                if _WORD.match(w):
                    found.add(w.lower())
                if w[0] not in _MAY_LEAD:
                    break
                w = w[1:]
    return found


_NONE: Counter = Counter()


class Verdicts:
    """What the document itself, the corpus and the fixed list say of words with a period.

    What is asked of the document is counted in one pass over it, when first needed, so long documents cost no more a word.
    """

    def __init__(self, corpus: dict[str, str], text: str) -> None:
        self.corpus, self.text = corpus, text

    @cached_property
    def own(self) -> dict[str, Counter]:
        found: dict[str, Counter] = {}
        for w, kind in period_uses(self.text):
            found.setdefault(w, Counter())[kind] += 1
        return found

    @cached_property
    def small(self) -> str:
        return self.text.lower()

    @cached_property
    def plain(self) -> set[str]:
        """Words that stand without a period behind them, as written."""
        return set(_PLAIN.findall(self.text))

    @cached_property
    def inside(self) -> set[str]:
        """Capitalised words right behind a small letter, so inside a sentence."""
        return set(_NAMED.findall(self.text))

    def again(self, word: str) -> bool:
        """Whether the word is used with a period more than once, in whatever case."""
        w = word.lower()
        if len(self.text) <= SHORT and "Σ" not in self.text and self.small.count(w + ".") < 2:  # a sigma's small form depends on its place
            return False
        return sum(self.own.get(w, _NONE).values()) > 1

    def of(self, word: str) -> str:
        """'' for an ordinary word, 'never' and 'may' for abbreviations by whether they can end a sentence.

        The document's own unambiguous uses decide first, then the corpus, then the list: a word that stands twice before a
        small letter, and never without its period, is an abbreviation; one at a block's end, and never before a small letter,
        can end a sentence, and is an ordinary word if it also stands without its period.
        """
        if len(word) == 1 and word.isupper():
            return "never"  # an initial
        w = word.lower()
        seen = self.own.get(w, _NONE) if self.again(word) else _NONE
        if seen["L"] >= 2 and word not in self.plain:
            return "may" if seen["E"] or self.elsewhere(w, word) == "may" else "never"
        told = self.elsewhere(w, word)
        if told and seen["E"] and not seen["L"]:  # it can be last here; an ordinary word also stands without a period
            return "" if word in self.plain or w in self.plain else "may"
        return told

    def elsewhere(self, small: str, word: str) -> str:
        """What the corpus says of a word, or else the fixed list."""
        if small in self.corpus:
            return self.corpus[small]
        if small in NEVER_LAST:
            return "never"
        if small in MAY_BE_LAST or _ABBREVIATED.match(word):
            return "may"
        return ""

    def is_name(self, at: int) -> bool:
        """Whether the capitalised word at a place stands capitalised inside a sentence elsewhere in the document, and never small."""
        m = _LETTERS.match(self.text, at)
        return m is not None and m.group() in self.inside and m.group().lower() not in self.plain


def _quote_opens(text: str, start: int, end: int) -> bool:
    """Whether the sentence begins with a quotation mark."""
    at = _SKIP.match(text, _OPENING.match(text, start, end).end(), end).end()
    return at < end and text[at] in _OPENERS


def _ends(text: str, cur: int, m: regex.Match, close: int, end: int, v: Verdicts) -> bool:
    """Whether the marks m, with what closes behind them up to `close`, end the sentence that began at cur."""
    run, s, e = m.group(), m.start(), m.end()
    quoted = any(c in _QUOTES for c in text[e:close])
    spaced = close >= end or text[close].isspace()
    follows = _next_kind(text, close, end)
    if follows == "E":
        return True
    if quoted and follows == "-":
        return False
    chars = set(run)
    if chars & _WIDE or (chars & {"!", "?"} and not spaced and (_CJK.match(text, close) or s and _CJK.match(text, s - 1))):
        if quoted and not spaced:
            if text.startswith(_PARTICLES, close):
                return False
            return not _quote_opens(text, cur, end) or text[close] in _OPENERS + "（("
        return True
    if chars & _OTHER:
        return not (quoted and follows in "LO" and _quote_opens(text, cur, end))
    if not spaced:
        return "……" in run and _CJK.match(text, s - 1) is not None
    if quoted and follows in "LO" and _quote_opens(text, cur, end):
        return False
    if chars & {"!", "?"}:
        return not (follows == "L" and close > e)
    if len(run) > 1 or "…" in chars:
        return follows != "L"
    word = _token(text, cur, s)
    if word.isdigit():
        before = _BEFORE.search(text, max(cur, s - 40), s - len(word))
        return not (before and before.group(1).lower() in ORDINAL_BEFORE and len(word) <= 2 and int(word) <= 31)
    if not word.isalpha() and not _WORD.match(word):
        return True
    verdict = v.of(word)
    if not verdict:
        return True
    if verdict == "never" or follows in "L-":
        return False
    if follows == "U":
        at = _INNER.match(text, _SKIP.match(text, close, end).end(), end).end()
        return not v.is_name(at) or v.corpus.get(word.lower()) == "may"
    return True


def sentences(text: str | None, corpus: dict[str, str] | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, without white space at either end.

    corpus: words with a period, and whether they are abbreviations that `may` or `never` end a sentence, or ordinary ('').
    Blank and null texts have no sentences.
    """
    if not text or text.isspace():
        return []
    v, out = Verdicts(corpus or {}, text), []
    highest = max(text)
    marks = _MARKS_GREEK if highest > "Ͱ" and _GREEK.search(text) else _MARKS
    thai = "฀" <= highest and _THAI.search(text) is not None

    def add(a: int, z: int) -> None:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            out.append((a, z))

    for a, z, fenced in blocks(text):
        if fenced:
            add(a, z)
            continue
        cur, first = a, _OPENING.match(text, a, z).end()
        cuts = [(m.start(), m) for m in marks.finditer(text, first, z)]
        if thai:
            cuts = sorted(cuts + [(m.start(), m) for m in _THAI.finditer(text, first, z)], key=lambda x: x[0])
        done = first
        for s, m in cuts:
            if s < done:
                continue
            if m.re is _THAI:
                if m.group().strip("\u200b"):
                    add(cur, s)
                    cur = done = m.end()
                continue
            e = m.end()
            if ";" in m.group() or ";" in m.group():
                if m.group() not in (";", ";") or not _GREEK.search(text, cur, s):
                    continue
            close = e
            if e < z and text[e] in _MAY_CLOSE:
                close = (_CLOSING_DE if text.find("„", cur, e) >= 0 or text.find("‚", cur, e) >= 0 else _CLOSING).match(text, e, z).end()
            if close == e and text.find("«", cur, e) >= 0 and (f := _FRENCH.match(text, e, z)):
                if text.count("«", cur, e) > text.count("»", cur, e):
                    close = f.end()
            if highest > "\u2030" and _MAY_BE_EMOJI.match(text, close, z) and (x := _EMOJI.match(text, close, z)):
                close = x.end()
            if _ends(text, cur, m, close, z, v):
                add(cur, close)
                cur = done = close
        add(cur, z)
    return out


def abbreviations(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, verdict): the words that the corpus shows to be abbreviations that `may` or `never` end a sentence.

    Words of the fixed list that it shows to be ordinary are there with an empty verdict.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(u for t in b["text"] if t for u in period_uses(t))
            plain: Counter = Counter()
            for t in b["text"]:
                if t:
                    plain.update(_PLAIN.findall(t.lower()))
            rows = [(w, k, c) for (w, k), c in n.items()] + [(w, "N", c) for w, c in plain.items()]
            yield pd.DataFrame(rows, columns=["word", "kind", "n"])

    uses = spread(docs.select(F.col(text).alias("text"))).mapInPandas(count, "word string, kind string, n bigint")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    words = uses.groupBy("word").agg((F.sum("n") - of("N")).alias("uses"), of("L").alias("mid"), of("E").alias("last"), of("N").alias("plain"))
    words = words.where("uses > 0")
    share = lambda c: F.col(c) / F.col("uses")
    few, many = F.col("uses") >= FEW, F.col("uses") >= MANY
    seldom = share("last") <= LAST_SHARE
    is_one = (few & (share("mid") >= MID_FEW)) | (many & ((share("mid") >= MID_MANY) | (seldom & (share("plain") <= PLAIN_SHARE))))
    ordinary = many & (share("mid") < MID_ORDINARY) & ~seldom & F.col("word").isin(*sorted(NEVER_LAST | MAY_BE_LAST))
    verdict = F.when(is_one, F.when(seldom, "never").otherwise("may")).when(ordinary, "")
    return words.select("word", verdict.alias("verdict")).where("verdict is not null")


def split_documents(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc, start_char, end_char): the sentences of every document, whatever its language or script.

    Null, empty and blank texts have none; rows are independent, so repeated rows repeat their sentences; texts are taken
    whole; other columns are ignored; an empty table gives an empty result. The corpus's abbreviations are broadcast if
    there are at most `max_broadcast` of them, which is counted; otherwise they are joined to the words of the documents.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            uses = [(r, w) for r, t in zip(b["row"], b["text"], strict=True) for w in asked_words(t)]
            yield pd.DataFrame(uses, columns=["row", "word"])

    found = abbreviations(docs, text=text).persist()
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null")
    small = found.count() <= max_broadcast
    if small:
        shared = docs.sparkSession.sparkContext.broadcast({r.word: r.verdict for r in found.collect()})
        found.unpersist()
        rows = spread(rows)
    else:
        shared = None
        rows = rows.withColumn("row", F.xxhash64("doc", "text"))
        used = rows.select("row", "text").mapInPandas(ask, "row bigint, word string")
        verdicts = used.distinct().join(found, "word").groupBy("row").agg(F.collect_list("word").alias("words"), F.collect_list("verdict").alias("verdicts"))
        rows = rows.join(verdicts, "row", "left").select("doc", "text", "words", "verdicts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, starts, ends = [], [], []
            lists = [None] * len(b) if small else [None if w is None else dict(zip(w, x, strict=True)) for w, x in zip(b["words"], b["verdicts"], strict=True)]
            for i, t, own in zip(b["doc"], b["text"], lists, strict=True):
                for s, e in sentences(t, shared.value if small else own):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({"doc": pd.Series(ids, dtype="Int64"), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})

    return rows.mapInPandas(cut, "doc bigint, start_char int, end_char int").withColumnRenamed("doc", doc)
