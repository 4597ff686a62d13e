"""Near-duplicate texts by anchor-point covering.

A text's fingerprint is a row of words over a large alphabet; a letter is the minimum of the
hashed shingles under one hash function, so two texts agree on a letter with probability equal
to the Jaccard similarity of their shingle sets.  Fingerprints are not compared with each other
but with *anchors*, the code words of a covering code: here the single-parity-check code
[n, n - 1] (the last letter is a function of the others).  It has covering radius 1, and the
code words within 1 of a given word are exactly ``n``: choose the place to correct.  Every word
is replicated to all of them.  Two words that differ in at most one place have the same anchor
where that place is corrected, so a pair within threshold 1 always meets; only texts at the
same anchor are compared.  Texts that share a few common sentences meet too, the more often the
larger the collection is, so a pair is looked at by its sets only if a bound that never lies below
the similarity (``possible``) leaves it open.

A pair is lost only if all its words differ in two places or more: with 10 words of length 4,
0.16 % of pairs at similarity 0.6, 0.004 % at 0.7.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

WORDS, LENGTH = 10, 4
#: Longs of a text's marks; sets of more than ``LONG_SET`` shingles have ``LONG_MARKS`` further ones.
MARKS, LONG_MARKS, LONG_SET = 4, 16, 160
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codes(dict):
    """Hashes of words, kept as long as there are not too many of them."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def of(self, words: list[str], remember: int = 200_000) -> np.ndarray:
        if len(self) > remember:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Shingler:
    """Hashed sets of consecutive words."""

    def __init__(self, shingle: int):
        self.shingle, self.known = shingle, Codes()

    def __call__(self, text: str | None, min_words: int = 0) -> np.ndarray | None:
        words = _WORD.findall(text.lower()) if text else []
        if len(words) < max(min_words, self.shingle):
            return None
        codes = self.known.of(words)
        n = len(codes) - self.shingle + 1
        mixed = codes[:n].copy()
        for j in range(1, self.shingle):
            mixed = _mixed(mixed * _MIX + codes[j : j + n])
        return np.unique(mixed)


def _seeds(count: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, size=count, dtype=np.uint64) | np.uint64(1)


def minima(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each hash function, the least value over the set (32 bits)."""
    out = np.empty(len(seeds), dtype=np.uint64)
    step = max(1, 1_000_000 // len(seeds))
    out[:] = np.iinfo(np.uint64).max
    for i in range(0, len(shingles), step):
        part = (shingles[i : i + step, None] * seeds) >> np.uint64(32)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def marks(shingles: np.ndarray) -> np.ndarray:
    """Whether the number of shingles at each place is odd, as bits of longs: places modulo 256, and for long
    sets also modulo 1,024."""
    odd = (np.bincount((shingles & np.uint64(64 * LONG_MARKS - 1)).astype(np.int64), minlength=64 * LONG_MARKS) & 1).astype(np.uint8)
    long = np.packbits(odd, bitorder="little").view(np.int64)
    short = np.bitwise_xor.reduce(long.reshape(-1, MARKS), axis=0)
    return np.concatenate([short, long]) if len(shingles) > LONG_SET else short


def possible(a: str, b: str, na: str, nb: str, threshold: float) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles with marks ``a`` and ``b`` may be that similar.

    Two sets' marks differ in at most as many places as there are shingles in one of them only, which
    bounds the shared ones from above; no pair that reaches the threshold is refused.
    """
    n = F.col(na) + F.col(nb)

    def open_(places: range) -> Column:
        apart = reduce(Column.__add__, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in places])
        return (n - apart) / 2 / (n - (n - apart) / 2) >= threshold

    long = (F.col(na) > LONG_SET) & (F.col(nb) > LONG_SET)
    return (F.least(na, nb) >= F.greatest(na, nb) * threshold) & open_(range(MARKS)) & (~long | open_(range(MARKS, MARKS + LONG_MARKS)))


def anchors(letters: np.ndarray) -> np.ndarray:
    """The code words within distance 1 of each word of each row (rows x letters), as hashes of
    (word number, corrected place, code word).

    The code word in which place ``j`` is corrected is determined by the other places.
    """
    words = letters.reshape(len(letters), WORDS, LENGTH)
    found = np.empty_like(words)
    with np.errstate(over="ignore"):
        for j in range(LENGTH):
            h = np.broadcast_to((np.arange(WORDS, dtype=np.uint64) * np.uint64(LENGTH) + np.uint64(j + 1)) * _MIX, words.shape[:2])
            for i in range(LENGTH):
                if i != j:
                    h = _mixed((h + words[:, :, i]) * _MIX)
            found[:, :, j] = h
    return found.reshape(len(letters), WORDS * LENGTH)


def _fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int) -> DataFrame:
    """``id``, ``n`` shingles, ``same`` (digest of the set), anchors and ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seeds = Shingler(shingle), _seeds(WORDS * LENGTH)
        for batch in batches:
            ids, sizes, same, letters, marked = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingler(text, min_words)
                if found is None:
                    continue
                ids.append(key)
                sizes.append(len(found))
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                letters.append(minima(found, seeds))
                marked.append(marks(found))
            m = np.array(letters, dtype=np.uint64).reshape(len(ids), WORDS * LENGTH)
            places = anchors(m).view(np.int64)
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * (WORDS * LENGTH)
            ends = np.cumsum([0, *map(len, marked)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *marked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.ravel())), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "n", "same", "anchors", "marks"],
            )

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return source.mapInArrow(run, "id bigint, n int, same binary, anchors array<bigint>, marks array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, kept = Shingler(shingle), {}
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            value = np.zeros(len(a))
            for i in range(len(a)):
                sets = []
                for key, text in ((a[i], ta[i]), (b[i], tb[i])):
                    if key not in kept:
                        if len(kept) > 2000:
                            kept.clear()
                        kept[key] = shingler(text)
                    sets.append(kept[key])
                shared = len(np.intersect1d(*sets, assume_unique=True))
                value[i] = shared / (len(sets[0]) + len(sets[1]) - shared)
            keep = np.flatnonzero(value >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(value[keep])], names=["a", "b", "similarity"])

    wanted = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    near = texts.join(wanted, "id", "left_semi")
    first = near.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    second = near.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, shingle: int = 3, min_words: int = 40) -> tuple[DataFrame, DataFrame]:
    """Members (``id``, ``cid``) of the classes of equal shingle sets, and links between classes.

    Links are ``a`` < ``b`` (class ids, the least id of each) and their exact ``similarity``.
    Null ids and texts, and texts of fewer than ``min_words`` words, take no part; a repeated
    row counts once; other columns are not read; empty input gives empty tables.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    prints = settle(_fingerprints(df, id_col, text_col, shingle, min_words), "prints")
    classes = prints.groupBy("same").agg(F.min("id").alias("cid"))
    members = prints.select("id", "same").join(classes, "same").select("id", "cid").distinct()
    reps = prints.join(classes, (prints["id"] == classes["cid"]) & (prints["same"] == classes["same"]), "left_semi").select("id", "n", "marks", F.explode("anchors").alias("anchor"))
    left = reps.select("anchor", F.col("id").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma"))
    right = reps.select("anchor", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb"))
    met = left.join(right, "anchor").where((F.col("a") < F.col("b")) & possible("ma", "mb", "na", "nb", threshold))
    pairs = settle(met.select("a", "b").distinct(), "candidates")
    return settle(members, "members"), settle(_verified(pairs, texts, shingle, threshold).distinct(), "links")


def near_pairs(df: DataFrame, id_col: str, text_col: str, **params) -> DataFrame:
    """Distinct ``id_a`` < ``id_b`` whose similarity is at least the threshold, copies included."""
    members, links = near_classes(df, id_col, text_col, **params)
    a, b = members.select(F.col("id").alias("x"), F.col("cid").alias("a")), members.select(F.col("id").alias("y"), F.col("cid").alias("b"))
    between = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.unionAll(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``group_id``: the least node of each connected component.

    Alternating large-star and small-star steps, each written to the shared folder; ends when
    a round changes nothing.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = settle(small, "edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    heads = edges.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.join(heads, nodes["node"] == heads["u"], "left").select("node", F.coalesce("v", "node").alias("group_id"))


def near_groups(df: DataFrame, id_col: str, text_col: str, **params) -> DataFrame:
    """One row for each text that takes part: ``id_col``, ``class_id`` (equal shingle sets),
    ``group_id`` (connected by links) and ``n_links`` of its class to other classes."""
    members, links = near_classes(df, id_col, text_col, **params)
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    groups = components(links, members.select(F.col("cid").alias("node")).distinct())
    return (
        members.join(groups, members["cid"] == groups["node"]).drop("node").join(degree, "cid", "left")
        .select(F.col("id").alias(id_col), F.col("cid").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
