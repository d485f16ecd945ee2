"""Near-duplicate records by circulant MinHash, banding and exact Jaccard verification.

Equal records collapse to a class with one representative first; only representatives are compared. A signature of K
coordinates comes from two permutations of one universe: the first scatters the shingles, the second, shifted circularly by
k places, gives coordinate k. Bands of R coordinates are shuffled as 64-bit keys; records that share one are candidates, and
each candidate pair is verified on its whole shingle sets. A set that fills much of the universe has the least values of any
other such set, so large records have a larger universe; those near the border have keys of both.

Most bands are of one record and drop out with their count. A band of very many different records is cut into cells, each of two
blocks of its records, so that its pairs are spread over tasks and none is lost.

With R = 3 and 48 bands a pair of likeness 0.6 is missed with probability (1 - 0.6**3)**48 = 8e-6, one of 0.8 with 3e-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Places of the permuted universe, a power of two, kept as a table of 4 MB; and of that of large records, which is computed.
UNIVERSE, LARGE_UNIVERSE = 1 << 20, 1 << 40
#: Distinct shingles up to which a record is small.
SMALL = 1 << 16
BANDS, ROWS = 48, 3
#: Records of a band that meet in one cell, from each of its two blocks.
BLOCK = 1_000

_SECOND: dict = {}


def _second_permutation(seed: int, k: int) -> np.ndarray:
    """All windows of k circularly successive values of the second permutation; row p holds coordinates 0..k-1 of place p."""
    if (seed, k) not in _SECOND:
        p = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
        _SECOND[seed, k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[: k - 1]]), k)
    return _SECOND[seed, k]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _first_permutation(hashes: np.ndarray, seed: int, universe: int) -> np.ndarray:
    """Places of 64-bit hashes in the universe: the upper bits of a bijective mix."""
    x = hashes.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    return (_mixed(x) >> np.uint64(64 - universe.bit_length() + 1)).astype(np.int64)


def _large_coordinates(places: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The least values of the second permutation of the large universe over all places, shifted by 0..k-1.

    The permutation multiplies by odd numbers and folds upper bits onto lower ones, modulo the universe, so it is a bijection.
    """
    mask, half = np.uint64(LARGE_UNIVERSE - 1), np.uint64(LARGE_UNIVERSE.bit_length() // 2)
    out = np.empty(k, dtype=np.int64)
    for shift in range(k):
        x = (places.astype(np.uint64) + np.uint64(shift)) & mask
        for odd in (seed * 2 + 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
            x = (x * np.uint64(odd % 2**64 | 1)) & mask
            x ^= x >> half
        out[shift] = x.min()
    return out


def signatures(flat: np.ndarray, starts: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The k signature coordinates of each non-empty set of hashes flat[starts[i]:starts[i + 1]], in the small universe."""
    view, places = _second_permutation(seed, k), _first_permutation(flat, seed, UNIVERSE)
    out = np.empty((len(starts), k), dtype=np.int32)
    ends = np.append(starts[1:], len(flat))
    a = 0
    while a < len(starts):  # sets in portions of about 64k hashes; a larger set goes through in slices
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + 65_536, side="right")))
        if z == a + 1 and ends[a] - starts[a] > 65_536:
            out[a] = np.min([view[places[s : min(s + 65_536, ends[a])]].min(axis=0) for s in range(starts[a], ends[a], 65_536)], axis=0)
        else:
            out[a:z] = np.minimum.reduceat(view[places[starts[a] : ends[z - 1]]], starts[a:z] - starts[a], axis=0)
        a = z
    return out


def large_signatures(flat: np.ndarray, starts: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The same in the large universe."""
    ends = np.append(starts[1:], len(flat))
    return np.array([_large_coordinates(_first_permutation(flat[a:z], seed, LARGE_UNIVERSE), k, seed) for a, z in zip(starts, ends, strict=True)], dtype=np.int64).reshape(len(starts), k)


def _keys(sig: np.ndarray, bands: int, rows: int, kind: int) -> np.ndarray:
    """(records, bands): a 64-bit key of each band of the signatures."""
    sig = sig.reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1 + kind * bands, 1 + (kind + 1) * bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
    for r in range(rows):
        key = (key ^ sig[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def _band_keys(bands: int, rows: int, seed: int, threshold: float, small: int):  # noqa: ANN202
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sh = b.column(2)
            offsets = np.asarray(sh.offsets, dtype=np.int64)
            flat = np.asarray(sh.values, dtype=np.int64)[offsets[0] : offsets[-1]].view(np.uint64)
            starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
            # a pair of enough likeness has sizes in that proportion, so both are small or both have keys of the large universe
            kinds = [(0, sizes <= small, signatures), (1, sizes >= small * threshold, large_signatures)]
            parts, owners = [], []
            for kind, which, sign in kinds:
                if which.all():
                    parts.append(_keys(sign(flat, starts, bands * rows, seed), bands, rows, kind).reshape(-1))
                elif which.any():
                    own = np.flatnonzero(which)
                    sets = [flat[starts[i] : starts[i] + sizes[i]] for i in own]
                    parts.append(_keys(sign(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), bands * rows, seed), bands, rows, kind).reshape(-1))
                owners.append(np.repeat(np.flatnonzero(which), bands))
            owner, key = np.concatenate(owners), np.concatenate(parts)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(key[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "digest", "bands"])

    return keys


def shingled(df: DataFrame, *, width: int) -> DataFrame:
    """(id, digest, shingles): distinct 64-bit hashes of the runs of `width` successive words; rows with fewer words are left out.

    Words are runs of ASCII letters, digits and `_` in lower case. Two different runs have one hash with probability 2**-64.
    """
    words = df.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)).alias("words")).where(F.size("words") >= width)
    run = lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(width)])
    return words.select(
        "id",
        F.sha2(F.array_join("words", " "), 256).alias("digest"),
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - width), run)).alias("shingles"),
    )


def near_duplicates(df: DataFrame, *, id: str, text: Column, threshold: float = 0.8, width: int = 5, bands: int = BANDS, rows: int = ROWS, seed: int = 7, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:  # noqa: A002
    """Classes of equal records, and all pairs of classes with a likeness of at least `threshold`.

    Returns members (id, rep): every record with `width` words or more and its class, named by its least id; and links
    (rep_a, rep_b, likeness) with rep_a < rep_b. Likeness is the number of shared distinct runs of `width` words divided by
    the number that either has. Ids must be unique; null ids or texts and shorter texts are in neither result. `small` and `block` change
    the cost of large records and of bands of many records, not the result.
    """
    df = df.select(F.col(id).cast("long").alias("id"), text.alias("text")).where("id is not null and text is not null")
    sets = shingled(df, width=width)
    keyed = materialize(sets.mapInArrow(_band_keys(bands, rows, seed, threshold, small), "id bigint, digest string, bands array<bigint>"), "bands")
    classes = keyed.groupBy("digest").agg(F.min("id").alias("rep"))
    members = keyed.select("id", "digest").join(classes, "digest").select("id", "rep")
    reps = keyed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("bands").alias("band"))
    candidates = materialize(_meetings(reps, block).distinct(), "candidates")
    needed = candidates.select(F.col("rep_a").alias("id")).union(candidates.select("rep_b")).distinct()
    full = materialize(shingled(df.join(needed, "id", "left_semi"), width=width).select("id", "shingles"), "shingles")
    a, b = (full.select(F.col("id").alias(f"rep_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = candidates.join(a, "rep_a").join(b, "rep_b").withColumn("shared", F.size(F.array_intersect("set_a", "set_b")))
    links = both.select("rep_a", "rep_b", (F.col("shared") / (F.size("set_a") + F.size("set_b") - F.col("shared"))).alias("likeness"))
    return members, links.where(F.col("likeness") >= threshold)


def _meetings(reps: DataFrame, block: int) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b: the pairs of records (id) that share a band, repeated for each that they share.

    Counts are combined before they are shuffled. Bands of up to `block` records are joined as they are. Those of more are cut
    into blocks by a hash of the record; a record goes to one cell for each block, with its own one, and each pair meets in one.
    """
    counts = reps.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(reps.join(counts, "band"), "bands")
    cool, hot = shared.where(F.col("n") <= block), shared.where(F.col("n") > block)
    blocks = F.ceil(F.col("n") / block)
    cells = hot.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = cells.select("id", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).repartition("band", "low", "high")

    def pairs(df: DataFrame, keys: list[str], apart: Column) -> DataFrame:
        sides = [df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in keys]) for x in "ab"]
        return sides[0].join(sides[1], keys).where(F.col("id_a") < F.col("id_b")).where(apart).select(F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b"))

    inside = pairs(cool.select("id", "band"), ["band"], F.lit(True))
    return inside.unionByName(pairs(cells, ["band", "low", "high"], (F.col("low") == F.col("high")) | (F.col("own_a") != F.col("own_b"))))


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs of records that the links of their classes stand for, those within a class included."""
    m = lambda x: members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}"))
    several = members.groupBy("rep").count().where("count > 1").select("rep")
    copies = members.join(several, "rep", "left_semi")
    within = copies.select(F.col("id").alias("id_a"), "rep").join(copies.select(F.col("id").alias("id_b"), "rep"), "rep").where("id_a < id_b")
    across = links.join(m("a"), "rep_a").join(m("b"), "rep_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return within.select("id_a", "id_b").unionByName(across)


def record_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links): each record with its class and the number of other classes its class is linked to."""
    ends = links.select(F.col("rep_a").alias("rep")).union(links.select("rep_b"))
    return members.join(ends.groupBy("rep").agg(F.count("*").alias("links")), "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
