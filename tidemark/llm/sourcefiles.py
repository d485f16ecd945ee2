"""Source files that nobody wrote by hand for their repository: generated, minified, data saved as code, or copied in.

Three linear support-vector classifiers are trained on hashed features of a bounded sample of files: one on character n-grams
of the code without its comments (so that giveaway headers are masked), one on character n-grams of the comment lines above the
code, one on path components. The first learns from structure, the second from what stands above code that the structure or the
folder gives away, so it also knows headers of forms that no pattern lists; the third, which judges files without content, from
the paths of the files that the other two have judged. Validation is split by repository. Copies are found by a digest of the
code without white space and comments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize, spread

#: Files of the training sample, about; all files of smaller tables. The only sampling: every file is judged.
SAMPLE_FILES = 4_000
#: Hashed features of each view; weights of all three take 768 kB at most.
FEATURES = 1 << 15
#: Files of the sample that a path component must be of to count.
LEAST_PATHS = 8
#: Comment lines of a file of the sample that are used in training, at most; all lines are judged.
SAMPLE_LINES = 20
#: One repository in so many is held out for validation.
HELD_OUT = 5

# Endings of languages whose comments begin with `#`.
HASH_COMMENTS = frozenset("py pyi rb sh pl r jl yml yaml toml".split())
# Folders of copied-in projects.
VENDOR_FOLDERS = frozenset("vendor _vendor third_party thirdparty third-party node_modules external extern deps bower_components".split())
# Wordings above generated files, anchored to be about the file itself. They label the sample and judge no file.
GIVEAWAYS = re.compile(
    r"^\W*(?:code generated by\b|@generated\b|auto-?generated (?:file|by|from|code)|<auto-generated|(?:this|the) (?:file|code) (?:is|was|has been) (?:automatically|auto-?|machine)[ -]?generated"
    r"|generated (?:by|from|with) \S+|automatisch erzeugt|autogenerado|g[ée]n[ée]r[ée] automatiquement|автоматически сгенерирован|自动生成|.*自動生成)",
    re.I | re.M,
)
# Forms of a project's notice; the group is the project.
NOTICE = re.compile(
    r"SPDX-FileCopyrightText:\s*(?:\d{4}(?:-\d{4})?\s+)?(?:the\s+)?([\w.-]+)|(?:copyright|\(c\)|©)\s*(?:\(c\)\s*)?(?:\d{4}(?:-\d{4})?,?\s+)?(?:by\s+)?(?:the\s+)?([\w.-]+)\s+(?:project|authors|contributors|team|developers)"
    r"|\b(?:vendored|imported) from\s+(?:https?://)?([\w.-]+\.\w{2,}/[\w./-]+)",
    re.I,
)
# Fixed value: a remark that a file comes from another repository of the collection, to which it may belong.
TAKEN = re.compile(r"\b(?:taken|copied|borrowed|adapted|lifted) from\s+([\w.-]+/[\w.-]+)", re.I)

_STRING = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_HASH = re.compile(r'"""[\s\S]*?"""|' + _STRING + r"|(#[^\n\r]*)")
_SLASH = re.compile(_STRING + r"|(//[^\n\r]*|/\*[\s\S]*?(?:\*/|\Z))")
_ABOVE_HASH = re.compile(r"(?:\s*#[^\n\r]*)+")
_ABOVE_SLASH = re.compile(r"(?:\s*(?://[^\n\r]*|/\*[\s\S]*?(?:\*/|\Z)))+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")
_NAME = re.compile(r"[A-Za-z_]\w+")


def _drop(m: re.Match) -> str:
    return "" if m.group(1) else m.group()


def split_comments(path: str, content: str) -> tuple[str, str]:
    """(code without comments, comments above it)."""
    hashed = path.rsplit(".", 1)[-1].lower() in HASH_COMMENTS
    above = (_ABOVE_HASH if hashed else _ABOVE_SLASH).match(content)
    return (_HASH if hashed else _SLASH).sub(_drop, content), above.group() if above else ""


def taken_elsewhere(full_name: str, above: str) -> bool:
    """Whether the comments say that the file comes from another repository."""
    return any(m.group(1).lower().rstrip(".") != full_name.lower() for m in TAKEN.finditer(above))


def comment_lines(above: str) -> list[str]:
    return [x for x in map(str.strip, re.split(r"[\r\n]+", above)) if re.search(r"\w", x)]


def code_digest(code: str) -> str:
    """A digest of code, white space aside; empty for none."""
    bare = _SPACE.sub("", code)
    return hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if bare else ""


def outside_notice(full_name: str, above: str) -> bool:
    """Whether the comments bear the notice of a project that is neither the repository nor its owner."""
    plain = lambda s: re.sub(r"[\W_]", "", s.lower())
    parts = {plain(full_name), *map(plain, full_name.split("/"))}
    for m in NOTICE.finditer(above):
        named = next(g for g in m.groups() if g)
        if plain(named) not in parts and not {plain(x) for x in named.split("/")[1:]} & parts:
            return True
    return False


# Character n-grams, over a whole batch of texts at once -------------------------------------------------------------

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_SHAPE[[9, 13]] = 32
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[48:58] = 48
_PLAIN[[9, 10, 13]] = 32


def _grams(texts: list[str], table: np.ndarray, sizes: tuple[int, ...], runs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all n-grams of the texts; with `runs`, runs of equal letters or digits count as one sign."""
    data = [np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(d) for d in data])
    x = table[np.concatenate(data)] if data else np.zeros(0, dtype=np.uint8)
    if runs and len(x):
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1]) | ~np.isin(x[1:], [97, 65, 48, 32])
        x, of = x[keep], of[keep]
    feats, owners = [], []
    for n in sizes:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ x[k : len(x) - n + 1 + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        inside = of[: len(h)] == of[n - 1 :]
        feats.append((h >> np.uint64(64 - FEATURES.bit_length() + 1))[inside].astype(np.int64))
        owners.append(of[: len(h)][inside])
    if not feats:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(feats), np.concatenate(owners)


def code_features(codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the code's shape: names, numbers and spaces as one sign each, everything else as it stands."""
    return _grams(codes, _SHAPE, (3, 6, 10), runs=True)


def comment_features(comments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return _grams(comments, _PLAIN, (4, 6), runs=False)


def path_features(paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whole folders, the ending, and the parts of the file's name at `.`, `_` and capitals, with their place."""
    feats, owners = [], []
    for i, p in enumerate(paths):
        *folders, name = p.split("/")
        parts = [f"d:{x.lower()}" for x in folders] + [f"0:{folders[0].lower()}" if folders else "0:"]
        stem, *endings = name.split(".")
        parts += [f"e:{'.'.join(endings).lower()}", f"x:{endings[-1].lower() if endings else ''}"]
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", stem)]
        parts += [f"w:{w}" for w in words] + ([f"l:{words[-1]}"] if words else [])
        for x in parts:
            feats.append(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % FEATURES)
            owners.append(i)
    return np.array(feats, dtype=np.int64), np.array(owners, dtype=np.int64)


VIEWS = {"code": code_features, "comment": comment_features, "path": path_features}


def scores(view: str, texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The classifier's margin for each text: the mean weight of its features, scaled as in training, and the bias."""
    f, of = VIEWS[view](texts)
    n = np.maximum(np.bincount(of, minlength=len(texts)), 1)
    return np.bincount(of, weights=weights[f], minlength=len(texts)) / n * _scale(view) + bias


def _scale(view: str) -> float:
    return 5.0 if view == "path" else 30.0


def line_says(full_name: str, line: str) -> bool:
    return bool(GIVEAWAYS.search(line)) or outside_notice(full_name, line) or taken_elsewhere(full_name, line)


# Weak labels ---------------------------------------------------------------------------------------------------------


def structure_evidence(code: str) -> bool | None:
    """Whether the code's structure shows that no hand wrote it; None if it is too short to tell or between.

    It does if lines are very long on the whole, if half of them have the form of one of the four before, or if little is
    left beside literals.
    """
    lines = [x.strip() for x in re.split(r"[\r\n]+", code) if x.strip()]
    size = sum(map(len, lines))
    if size < 80:
        return None
    if size / len(lines) > 200:
        return True
    bare = re.sub(_STRING, '"', code)
    if len(_SPACE.sub("", re.sub(r"[\d\s,\"\[\](){}.+-]|0x[0-9a-fA-F]+|\\x[0-9a-fA-F]{2}", "", bare))) < 0.12 * size:
        return True
    long = [x for x in lines if len(x) > 4]
    if len(long) < 8:
        return None
    forms = [_NAME.sub("w", _NUMBER.sub("0", re.sub(_STRING, '"', x))) for x in long]
    forms = [re.sub(r"(?:-?[0w\"],?\s*){4,}", "*", x) for x in forms]
    again = sum(x in forms[max(0, i - 4) : i] for i, x in enumerate(forms)) / len(forms)
    return None if 0.35 < again < 0.5 else again >= 0.5


def vendor_folder(path: str) -> bool:
    return any(x.lower() in VENDOR_FOLDERS for x in path.split("/")[:-1])


@dataclass
class Classifiers:
    """Weights and bias of each view, and for each the right and wrong verdicts on held-out repositories.

    validation: (view, labels, true positives, false positives, false negatives, true negatives). The labels of a view are
    those of its training (`rules`; `content` for paths) and, for code and comments, what the other of the two says (`other`).
    """

    views: dict[str, tuple[np.ndarray, float]]
    validation: list[tuple[str, str, int, int, int, int]]


def _feature_rows(view: str, rows: list[tuple[str, str, bool, bool | None, str]]) -> Iterator[pd.DataFrame]:
    """The rows (view, full_name, label, the other view's label, text) of a view with their features and values."""
    out: dict[str, list] = {"view": [], "full_name": [], "label": [], "other": [], "features": [], "values": []}
    own = [r for r in rows if r[0] == view]
    f, of = VIEWS[view]([r[4] for r in own])
    pairs, n = np.unique(of * FEATURES + f, return_counts=True)
    of, f = np.divmod(pairs, FEATURES)
    ends = np.searchsorted(of, np.arange(len(own) + 1))
    for r, a, z in zip(own, ends[:-1], ends[1:], strict=True):
        if a < z:
            for c, v in zip(out, (*r[:2], float(r[2]), None if r[3] is None else float(r[3]), f[a:z].tolist(), (n[a:z] / n[a:z].sum() * _scale(view)).tolist()), strict=True):
                out[c].append(v)
    if out["view"]:  # a column without values would have no type
        yield pd.DataFrame(out)


_LABELLED = "view string, full_name string, label double, other double, features array<int>, values array<float>"


def _code_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Code whose structure tells something, with that as its label."""
    for b in batches:
        rows = []
        for name, path, content in b[["full_name", "path", "content"]].itertuples(index=False):
            code, above = split_comments(path, content)
            made, copied = structure_evidence(code), outside_notice(name, above) or taken_elsewhere(name, above) or vendor_folder(path)
            if made is not None:  # comments tell of generated code only by saying so, and nothing of copied code
                rows.append(("code", name, made, True if GIVEAWAYS.search(above) else None if copied or not above else False, code))
        yield from _feature_rows("code", rows)


def _comment_rows(batches: Iterator[pd.DataFrame], weights: np.ndarray, bias: float) -> Iterator[pd.DataFrame]:
    """Comment lines, labelled by what the first classifier says of the code below, by the line's own words and by the folder."""
    for b in batches:
        files = [(n, p, *split_comments(p, c)) for n, p, c in b[["full_name", "path", "content"]].itertuples(index=False)]
        files = [x for x in files if code_digest(x[2]) and comment_lines(x[3])]
        made = scores("code", [x[2] for x in files], weights, bias) > 0
        rows = []
        for (name, path, code, above), m in zip(files, made.tolist(), strict=True):
            other = structure_evidence(code)
            rows += [("comment", name, m or line_says(name, x) or vendor_folder(path), other, x) for x in comment_lines(above)[:SAMPLE_LINES]]
        yield from _feature_rows("comment", rows)


def _path_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths, labelled by what the other classifiers say of the content."""
    for b in batches:
        rows = [("path", n, m or o, None, p) for n, p, m, o in b[["full_name", "path", "machine", "outside"]].itertuples(index=False)]
        yield from _feature_rows("path", rows)


def fit_support_vectors(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, cost: float = 10.0, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support-vector classifier with squared hinge loss, by dual coordinate descent."""
    w, bias = np.zeros(FEATURES), 0.0
    y = np.where(labels > 0, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    diagonal = np.array([v @ v for _, v in rows]) + 1.0 + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            gradient = y[i] * (w[idx] @ v + bias) - 1.0 + 0.5 / cost * alpha[i]
            step = max(alpha[i] - gradient / diagonal[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[idx] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(gradient))
        if moved < 0.01:
            break
    return w, bias


def train(files: DataFrame, *, sample_files: int = SAMPLE_FILES) -> Classifiers:
    """Fit the three classifiers on a sample of about `sample_files` files.

    The files are chosen by a hash of their name and turned into labelled features by the executors; the features, a bounded
    number, are fitted on the driver. Then the first two classifiers judge the sample, and the third is fitted to the paths.
    Repositories whose hash is divisible by HELD_OUT are kept for validation. A view without both labels gets weights of 0 and
    a bias of -1, which finds nothing.
    """
    rows = files.select("full_name", "path", "content").where("full_name is not null and path is not null")
    share = min(1.0, sample_files / max(1, rows.select("full_name").count()))
    sample = rows.where("content is not null").where(F.pmod(F.xxhash64("full_name", "path"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = materialize(sample, "sample")
    found = Classifiers({}, [])
    stages = {
        "code": lambda: sample.mapInPandas(_code_rows, _LABELLED),
        "comment": lambda: sample.mapInPandas(lambda b, w=found.views["code"]: _comment_rows(b, *w), _LABELLED),
        "path": lambda: judge(sample, found).where("digest <> ''").mapInPandas(_path_rows, _LABELLED),
    }
    for view, labelled in stages.items():
        told = labelled().withColumn("held_out", F.pmod(F.xxhash64("full_name"), F.lit(HELD_OUT)) == 0).drop("full_name").toPandas()
        found.views[view], checked = _fit(view, told)
        found.validation += checked
    return found


def _fit(view: str, told: pd.DataFrame) -> tuple[tuple[np.ndarray, float], list[tuple[str, str, int, int, int, int]]]:
    held_out = told["held_out"].astype(bool)
    fit, rest = told[~held_out].copy(), told[held_out]
    if view == "path":  # names of single files tell nothing of others
        n = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *fit["features"]]).astype(np.int64), minlength=FEATURES)
        fit["values"] = [np.where(n[np.asarray(i)] < LEAST_PATHS, 0.0, v) for i, v in zip(fit["features"], fit["values"], strict=True)]
    if fit["label"].nunique() < 2:
        return (np.zeros(FEATURES), -1.0), []
    w, bias = fit_support_vectors([(np.asarray(i), np.asarray(v, dtype=float)) for i, v in zip(fit["features"], fit["values"], strict=True)], fit["label"].to_numpy())
    said = np.array([w[np.asarray(i)] @ np.asarray(v, dtype=float) + bias > 0 for i, v in zip(rest["features"], rest["values"], strict=True)], dtype=bool)
    checked = []
    for kind, labels in (("content" if view == "path" else "rules", rest["label"]), ("other", rest["other"])):
        known = labels.notna().to_numpy()
        s, true = said[known], labels[known].to_numpy() > 0
        if known.any():
            checked.append((view, kind, int((s & true).sum()), int((s & ~true).sum()), int((~s & true).sum()), int((~s & ~true).sum())))
    return (w, bias), checked


_JUDGED = "full_name string, path string, fetched_at timestamp_ntz, file_id bigint, digest string, machine boolean, outside boolean"


def judge(files: DataFrame, found: Classifiers) -> DataFrame:
    """Each file by itself: the digest of its code (null without content), whether it is machine-made or taken by the
    classifiers and its comments (by its path without content), and whether these bear an outside project's notice.

    fetched_at and file_id, which are null where files has no such columns, stay; contents don't leave the task that reads them.
    """
    shared = files.sparkSession.sparkContext.broadcast(found.views)

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views = shared.value
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.iloc[k : k + 500]
                there = b["content"].notna().to_numpy()
                paths = b["path"].tolist()
                split = [split_comments(p, c) if t else ("", "") for p, c, t in zip(paths, b["content"], there, strict=True)]
                codes, aboves = [x[0] for x in split], [x[1] for x in split]
                digests = [code_digest(c) if t else None for c, t in zip(codes, there, strict=True)]
                lines = [(i, x) for i, a in enumerate(aboves) for x in comment_lines(a)]
                machine = scores("code", codes, *views["code"]) > 0
                if lines:
                    told = scores("comment", [x for _, x in lines], *views["comment"]) > 0
                    machine[[i for (i, _), y in zip(lines, told, strict=True) if y]] = True
                machine |= np.array([taken_elsewhere(n, a) for n, a in zip(b["full_name"], aboves, strict=True)], dtype=bool)
                if not there.all():
                    by_path = scores("path", paths, *views["path"]) > 0
                    by_path |= np.array([vendor_folder(p) for p in paths])
                    machine = np.where(there, machine, by_path)
                outside = [outside_notice(n, a) for n, a in zip(b["full_name"], aboves, strict=True)]
                yield b[["full_name", "path", "fetched_at", "file_id"]].assign(digest=digests, machine=machine, outside=outside)

    extra = [F.col(c).cast(t).alias(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("fetched_at", "timestamp_ntz"), ("file_id", "bigint"))]
    rows = files.where("full_name is not null and path is not null").select("full_name", "path", *extra, "content")
    return spread(rows).mapInPandas(tell, _JUDGED)


def landed_once(files: DataFrame, columns: list[str], *, there: Column) -> DataFrame:
    """(full_name, path, columns): one row per full_name and path: of several one with content (`there`), the latest fetched, the largest file_id."""
    latest = F.struct(there.alias("a"), "fetched_at", "file_id")
    rows = files.where("full_name is not null and path is not null").groupBy("full_name", "path").agg(F.max_by(F.struct(*columns), latest).alias("x"))
    return rows.select("full_name", "path", "x.*")


def not_by_hand(files: DataFrame, repositories: DataFrame, *, found: Classifiers | None = None) -> DataFrame:
    """(full_name, path): each file, once, that was generated, minified, copied in from another project, or is data saved as code.

    files: full_name, path, content, fetched_at, file_id; repositories: full_name, created_at. Files equal but for white space
    and comments that several repositories hold, and of which none bears an outside project's notice, belong to the oldest
    repository (equal ages: the first by name; repositories without an age come last); only the others' copies count. Files
    empty but for white space and comments never count, files without content are judged by their path, files without
    full_name or path are left out. An empty table gives an empty result; other columns are ignored.

    Every delivery is judged where it is read, in one scan; only the verdicts are written and shuffled. Files without content
    have no digest and don't meet the copies.
    """
    told = materialize(judge(files, found or train(files)), "judged")
    told = landed_once(told, ["digest", "machine", "outside"], there=F.col("digest").isNotNull())
    ages = repositories.where("full_name is not null").groupBy(F.lower("full_name").alias("repo")).agg(F.min("created_at").alias("age"))
    full = told.where("digest <> ''").withColumn("repo", F.lower("full_name")).join(ages, "repo", "left")
    age = F.struct(F.col("age").isNull().alias("unknown"), "age", "repo")
    groups = full.groupBy("digest").agg(F.min(age).alias("first"), F.max(age).alias("last"), F.max("outside").alias("any_outside"))
    several = groups.where("any_outside or first.repo <> last.repo").select("digest", F.col("first.repo").alias("owner"), "any_outside")
    copied = F.coalesce(F.col("any_outside") | (F.col("repo") != F.col("owner")), F.lit(False))
    counted = full.join(several, "digest", "left").where(F.col("machine") | F.col("outside") | copied)
    return counted.select("full_name", "path").unionByName(told.where("digest is null and machine").select("full_name", "path"))
