"""The k most similar vectors of every vector: a hash-prefix forest.

Each of several trees turns a vector into a long string of hash digits (a digit is the signed
axis of a random rotation on which the vector is longest) and keeps all strings in one sorted
array.  A search descends bit by bit to the longest prefix that at least ``LEAST`` rows share with the
vector's string, in every tree, and takes the rows of that prefix: its length varies with the data's
density.  Where a vector's own branch is smaller than that, the search ascends one step, in all trees
alike: the candidates are the branch and the rows of the sister branch next to it.  Where more rows
share a whole string (near-copies of one vector), a second string goes on, that of the vector less
its group's centre; ties of both are broken by a salt that differs from tree to tree.

The sorted array of a tree is cut into ranges at a sample of its strings; each range also gets the rows
next to its ends (a halo), so a vector at an end has neighbours on both sides.  Vectors travel about
once per tree as 16-bit integers (their cosines are off by about 0.000004), blocks of the array are
multiplied as matrices, and only each block's best pairs leave the task.  Equal directions are one
class throughout, so a vector that a third of all rows share costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

SCALE = 32767
#: Dimensions of the rotations behind each digit of a hash string: fine digits first.
DIGIT_DIMS = (64, 64, 32, 32, 32, 32)
#: Bits of a whole string; with the tree's number (6 bits) and a salt they fill 63 bits.
KEY_BITS = 38
#: Candidates a tree gives a vector: as many or more, and less than twice as many.
LEAST = 5120
#: Rows of a range, of a cell between two sampled strings, and cells of a halo.
ROWS_PER_RANGE, ROWS_PER_CELL, HALO = 65536, 512, 5
BLOCK = 512
#: A hot group's centre is the mean of about so many of its rows.
CENTRE_ROWS = 256
#: Bits of the salt behind a second string.
FINE_SALT_BITS = 25
#: Bits of the salt behind a first string.
SALT_BITS = 57 - KEY_BITS


def _unit_rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and those vectors at unit length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(good)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norms = np.sqrt((values**2).sum(axis=1))
    fit = np.isfinite(norms) & (norms > 0)
    return good[fit], values[fit] / norms[fit, None]


def quantised(df: DataFrame, id_col: str, vec_col: str, dims: int) -> DataFrame:
    """``id``, ``q`` (the unit vector as 16-bit integers) and its digest ``same``; unusable vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _unit_rows(batch.column(1), dims)
            q = np.rint(unit * SCALE).astype("<i2")
            raw = [x.tobytes() for x in q]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(raw, pa.binary()), pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())], names=["id", "q", "same"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where("id is not null and v is not null")
    return source.mapInArrow(run, "id bigint, q binary, same binary")


def rotations(dims: int, trees: int, seed: int) -> list[list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [[np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, : min(d, dims)].astype(np.float32) for d in DIGIT_DIMS] for _ in range(trees)]


def hash_strings(unit: np.ndarray, spins: list[np.ndarray]) -> np.ndarray:
    """One string for each row, its digits packed into a non-negative 64-bit integer."""
    key = np.zeros(len(unit), dtype=np.int64)
    at = np.arange(len(unit))
    for spin in spins:
        turned = unit @ spin
        axis = np.abs(turned).argmax(axis=1)
        bits = int(np.ceil(np.log2(2 * spin.shape[1])))
        key = (key << bits) | (2 * axis + (turned[at, axis] > 0))
    return key


def _with_strings(reps: DataFrame, spins: list[list[np.ndarray]], dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i2").reshape(-1, dims).astype(np.float32)
            keys = np.stack([hash_strings(unit, s) for s in spins], axis=1)
            offsets = np.arange(len(unit) + 1, dtype=np.int32) * len(spins)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["cid", "q", "keys"])

    return reps.mapInArrow(run, "cid bigint, q binary, keys array<bigint>")


def _block_pairs(ids: np.ndarray, unit: np.ndarray, first: int, last: int, lo: int, hi: int, k: int, min_cos: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of rows lo..hi for each of rows first..last, as pairs a < b."""
    cos = unit[first:last] @ unit[lo:hi].T
    rows = np.arange(first, last)
    inside = (rows >= lo) & (rows < hi)
    cos[np.flatnonzero(inside), rows[inside] - lo] = -2
    k = min(k, hi - lo - 1)
    if k < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.float32),)
    best = np.argpartition(cos, cos.shape[1] - k, axis=1)[:, -k:]
    value = np.take_along_axis(cos, best, 1)
    keep = value >= min_cos
    a, b = np.repeat(ids[first:last], k)[keep.ravel()], ids[lo:hi][best][keep]
    return np.minimum(a, b), np.maximum(a, b), value[keep]


def prefix_windows(key: np.ndarray, fine: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(first, last, lo, hi): rows first..last of one tree's sorted strings take rows lo..hi as candidates.

    Descends from the whole array while both branches of the next bit hold ``least`` rows.
    """
    found, stack = [], [(0, len(key), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        mid = lo
        while hi - lo >= 2 * least and depth < 2 * KEY_BITS:
            part, shift = (key, SALT_BITS + KEY_BITS - 1 - depth) if depth < KEY_BITS else (fine, FINE_SALT_BITS + 2 * KEY_BITS - 1 - depth)
            mid = lo + int(np.searchsorted((part[lo:hi] >> shift) & 1, 1))
            depth += 1
            if lo < mid < hi:
                break
            mid = lo
        if mid == lo:
            if hi - lo < 2 * least:
                found.append((lo, hi, lo, hi))
            else:  # more rows than that share both strings: the nearest by their salts
                found += [(i, min(hi, i + BLOCK), max(lo, i - least // 2), min(hi, i + BLOCK + least // 2)) for i in range(lo, hi, BLOCK)]
        else:
            for start, stop, near in ((lo, mid, (lo, min(hi, lo + least))), (mid, hi, (max(lo, hi - least), hi))):
                if stop - start < least:
                    found.append((start, stop, *near))
                else:
                    stack.append((start, stop, depth))
    return found


def _ordered(strings: DataFrame, dims: int, least: int, trees: int, seed: int) -> DataFrame:
    """``cid`` and ``q`` once a tree with the sort keys ``key``: the tree, the string, and a salt that
    lets ranges cut between equal strings; and ``fine``: in hot groups, in place of that salt, the
    string of the vector less the group's centre and a salt, else 0."""
    place = F.posexplode("keys").alias("tree", "key")
    spread = strings.select("cid", "q", place).select("cid", "q", "tree", F.shiftleft(F.col("tree").cast("bigint"), 57).bitwiseOR(F.shiftleft("key", SALT_BITS)).alias("at"))
    salt = lambda bits: F.pmod(F.xxhash64("cid", "tree"), F.lit(1 << bits))
    plain = lambda df: df.select("cid", "q", F.col("at").bitwiseOR(salt(SALT_BITS)).alias("key"), F.lit(0).cast("bigint").alias("fine"))
    hot = settle(spread.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least), "hot")
    if hot.isEmpty():
        return plain(spread)

    @F.pandas_udf("binary")
    def mean(groups: pd.Series) -> pd.Series:
        return groups.map(lambda qs: np.frombuffer(b"".join(qs), dtype="<i2").reshape(-1, dims).mean(axis=0).astype("<f4").tobytes())

    some = spread.join(hot, "at").where(F.pmod(F.xxhash64("cid", "tree"), F.col("n")) < CENTRE_ROWS)
    centres = settle(some.groupBy("at").agg(F.collect_list("q").alias("qs")).select("at", mean("qs").alias("centre")), "centres")
    spins = rotations(dims, trees, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i2").reshape(-1, dims)
            rest = q.astype(np.float32) - np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype="<f4").reshape(-1, dims)
            of, fine = batch.column(2).to_numpy(), np.zeros(len(q), dtype=np.int64)
            for t in np.unique(of):
                fine[of == t] = hash_strings(rest[of == t], spins[t])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(fine)], names=["cid", "q", "tree", "at", "fine"])

    dense = spread.join(centres, "at").select("cid", "q", "tree", "at", "centre").mapInArrow(run, "cid bigint, q binary, tree int, at bigint, fine bigint")
    dense = dense.select("cid", "q", F.col("at").alias("key"), F.shiftleft("fine", FINE_SALT_BITS).bitwiseOR(salt(FINE_SALT_BITS)).alias("fine"))
    return plain(spread.join(centres, "at", "left_anti")).unionByName(dense)


def _cells(keys: np.ndarray, fines: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Between which two of the sorted (key, fine) bounds each row lies."""
    cell = np.searchsorted(bounds[:, 0], keys, side="left")
    last = np.searchsorted(bounds[:, 0], keys, side="right")
    for key in np.unique(keys[last > cell]):  # strings that are bounds themselves
        at = keys == key
        own = bounds[bounds[:, 0] == key, 1]
        cell[at] += np.searchsorted(own, fines[at], side="right")
    return cell


def _ranges(spread: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``spread`` with ``range`` and whether it is the row's ``own``, and how many ranges there are.

    The bounds are a sample of a fixed share of the strings, 16 bytes for ``ROWS_PER_CELL`` rows.
    """
    some = spread.where(F.pmod(F.xxhash64("cid", "key", F.lit(5)), F.lit(ROWS_PER_CELL)) == 0).select("key", "fine").toPandas().to_numpy(dtype=np.int64).reshape(-1, 2)
    bounds = some[np.lexsort((some[:, 1], some[:, 0]))]
    wide, halo = ROWS_PER_RANGE // ROWS_PER_CELL, HALO
    ranges = max(1, len(bounds) // wide)

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, fines: pd.Series) -> pd.Series:
        """2 * range, and 1 more for the row's own one."""
        cell = _cells(keys.to_numpy(), fines.to_numpy(), bounds)
        own = np.minimum(cell // wide, ranges - 1)
        found = [[2 * int(x) + 1] for x in own]
        for i in np.flatnonzero((cell - own * wide < halo) & (own > 0)):
            found[i].append(2 * int(own[i]) - 2)
        for i in np.flatnonzero(((own + 1) * wide - cell <= halo) & (own < ranges - 1)):
            found[i].append(2 * int(own[i]) + 2)
        return pd.Series(found)

    placed = spread.select("cid", "q", "key", "fine", F.explode(places("key", "fine")).alias("p"))
    return placed.select("cid", "q", "key", "fine", F.floor(F.col("p") / 2).cast("int").alias("range"), (F.col("p") % 2 == 1).alias("own")), ranges


def candidate_pairs(strings: DataFrame, dims: int, least: int, k: int, min_cos: float, seed: int = 2025) -> DataFrame:
    """Pairs of classes that are close in some tree: ``a``, ``b`` and ``cosine``."""
    per_row = strings.select(F.size("keys")).first()
    placed, ranges = _ranges(_ordered(strings, dims, least, per_row[0] if per_row else 1, seed), least)

    def pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, key, fine, own = (rows.column(i).to_numpy() for i in (1, 3, 4, 5))
        unit = np.frombuffer(b"".join(rows.column(2).to_pylist()), dtype="<i2").reshape(-1, dims).astype(np.float32) / SCALE
        mine = np.flatnonzero(own)
        if not len(mine):
            return
        parts = []
        tree = key >> 57
        starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        for start, stop in zip(starts, [*starts[1:], len(key)]):
            for first, last, lo, hi in prefix_windows(key[start:stop], fine[start:stop], least):
                first, last = max(first + start, mine[0]), min(last + start, mine[-1] + 1)
                parts += [_block_pairs(ids, unit, i, min(i + BLOCK, last), lo + start, hi + start, k, min_cos) for i in range(first, last, BLOCK)]
        a, b, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(c[new])], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(0).to_numpy()
            for start in np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else ():
                stop = start + int(np.searchsorted(of[start:], of[start], side="right"))
                if held and held[-1].column(0)[0].as_py() != of[start]:
                    yield from pairs_of(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(int(start), stop - int(start)))
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    sorted_arrays = placed.repartitionByRange(ranges, "range").sortWithinPartitions("range", "key", "fine").select("range", "cid", "q", "key", "fine", "own")
    return sorted_arrays.mapInArrow(run, "a bigint, b bigint, cosine float").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _classes(df: DataFrame, id_col: str, vec_col: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """All usable rows with their class, and one row for each class with its vector."""
    rows = settle(quantised(df, id_col, vec_col, dims), "unit")
    reps = settle(rows.groupBy("same").agg(F.min("id").alias("cid"), F.first("q").alias("q")), "reps")
    members = rows.select("id", "same").join(reps.select("same", "cid").hint("merge"), "same").select("id", "cid").distinct()
    return members, reps.select("cid", "q")


def neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 10, dims: int = 64, trees: int = 6, least: int = LEAST, min_cos: float = -2.0, seed: int = 2024) -> DataFrame:
    """``id``, ``neighbour``, ``cosine``, ``rank``: up to ``k`` rows for each usable vector.

    Equal cosines rank the smaller id first.  Vectors that are null, of another length, all
    zero or not finite, or hold a null, take no part, nor do rows with a null id; repeated rows
    count once; other columns are not read.  Several ids with one direction are neighbours at
    cosine 1.  ``min_cos`` leaves out pairs below it.  ``least`` and ``trees`` are the search
    effort; the recall they give is measured by :func:`exact_neighbours`.
    """
    members, reps = _classes(df, id_col, vec_col, dims)
    members = settle(members, "members")
    strings = settle(_with_strings(reps, rotations(dims, trees, seed), dims), "strings")
    pairs = candidate_pairs(strings, dims, least, k, min_cos)
    ways = F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("other")), F.struct(F.col("b").alias("cid"), F.col("a").alias("other")))).alias("way")
    both = pairs.select(ways, "cosine").select("way.cid", "way.other", "cosine")  # not a union, which would run the forest twice
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= k).drop("r")
    return _to_ids(near, members, k)


def _to_ids(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From neighbouring classes to neighbouring ids.  Both sides of its joins grow with the data, so they are
    merge joins at every size."""
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = first.groupBy("cid").agg(F.sort_array(F.collect_list("id")).alias("heads"))  # at most k + 1 ids
    shared = heads.where(F.size("heads") > 1).select("cid", F.col("cid").alias("other"), F.lit(1.0).cast("float").alias("cosine"))
    options = (
        near.unionByName(shared)
        .join(heads.withColumnRenamed("cid", "other").hint("merge"), "other")
        .select("cid", "cosine", F.explode("heads").alias("neighbour"))
        .withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("cosine"), "neighbour")))
        .where(F.col("r") <= k + 1)
        .groupBy("cid")
        .agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "cosine"))).alias("found"))  # at most k + 1 structs
    )
    own = F.slice(F.filter("found", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return members.join(options.hint("merge"), "cid").select("id", F.posexplode(own).alias("at", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").cast("double").alias("cosine"), (F.col("at") + 1).alias("rank"))


def exact_neighbours(df: DataFrame, id_col: str, vec_col: str, k: int = 10, dims: int = 64, every: int = 50) -> DataFrame:
    """Brute force for the ids divisible by ``every``, against all rows, in blocks: for recall.

    The queries travel to every partition in bounded blocks as a broadcast file of their own
    size; the answer has ``id``, ``neighbour``, ``cosine``, ``rank``.
    """
    rows = settle(quantised(df, id_col, vec_col, dims).drop("same").distinct(), "exact")
    blocks = settle(
        rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(rows.count() // (every * 2000)))))
        .groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("q").alias("qs")),  # about 2,000 queries in each
        "blocks",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, qs, others, os_ in zip(*(batch.column(i).to_pylist() for i in range(4))):
                left = np.frombuffer(b"".join(qs), dtype="<i2").reshape(-1, dims).astype(np.float32) / SCALE
                right = np.frombuffer(b"".join(os_), dtype="<i2").reshape(-1, dims).astype(np.float32) / SCALE
                a, b = np.array(ids), np.array(others)
                cos = left @ right.T
                cos[a[:, None] == b[None, :]] = -2
                n = min(k, len(b))
                best = np.argpartition(cos, cos.shape[1] - n, axis=1)[:, -n:]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, n)), pa.array(b[best].ravel()), pa.array(np.take_along_axis(cos, best, 1).ravel())], names=["id", "neighbour", "cosine"])

    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(rows.count() // 4000)))).groupBy("part").agg(F.collect_list("id").alias("others"), F.collect_list("q").alias("os"))
    met = parts.join(blocks, F.lit(True)).select("ids", "qs", "others", "os").mapInArrow(run, "id bigint, neighbour bigint, cosine float")
    return met.where("cosine > -2").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 10, min_cos: float = 0.85, **search) -> DataFrame:
    """Distinct ``id_a`` < ``id_b`` of which one is among the ``k`` nearest of the other."""
    near = neighbours(df, id_col, vec_col, k=k, min_cos=min_cos, **search)
    return near.where(F.col("cosine") >= min_cos).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def recall(df: DataFrame, id_col: str, vec_col: str, k: int = 10, every: int = 50, **search) -> DataFrame:
    """One row: ``queries`` (ids divisible by ``every``), ``wanted`` neighbours and the share ``recall`` of them that
    the forest finds, or others as near (equal cosines are equally right)."""
    exact = settle(exact_neighbours(df, id_col, vec_col, k, every=every), "exact").groupBy("id").agg(F.count(F.lit(1)).alias("wanted"), F.min("cosine").alias("floor"))
    got = neighbours(df, id_col, vec_col, k=k, **search).where(F.pmod("id", F.lit(every)) == 0)
    hits = exact.join(got, "id", "left").where(F.col("cosine") >= F.col("floor") - 1e-5).groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    both = exact.join(hits, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"), F.round(F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")) / F.sum("wanted"), 4).alias("recall"))
