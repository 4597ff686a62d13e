"""Filling fixed-capacity containers: optimal length buckets over the global histogram.

Everything that must be decided globally is decided on the histogram of sizes, which never has
more than ``capacity`` rows however many items there are:

1. a dynamic programme chooses the bucket boundaries that minimise padding: the room that the
   buckets' own batches leave empty (each bucket's last batch aside) and, with a small weight, what
   each item would be padded by to its bucket's bound.  Buckets are runs of sizes; cuts are looked for at even shares of the histogram's weight;
2. token-budget batches are formed inside each bucket: a batch begins with the bucket's largest size
   left and takes the largest sizes of the bucket that still fit.  Equal batches are made once,
   with a multiplicity, so the plan has about as many rows as there are sizes.

Items then find their place by their rank among the items of their size.  Ranks come from salted
counts, so that a size that a third of all items share is not one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: A salted group of equal sizes has about so many rows.
GROUP_ROWS = 200_000
#: The dynamic programme looks for cuts at so many even shares of the weight.
CUTS = 9
#: A token by which an item would be padded to its bucket's bound counts so much beside one of empty room.
PAD_WEIGHT = 1e-4


def _batches(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Batches of one bucket as (how many alike, {size: items of it in each})."""
    left = dict(histogram)
    sizes = sorted(left)
    plan: list[tuple[int, dict[int, int]]] = []
    while sizes:
        room, uses, at = capacity, {}, len(sizes)
        while room > 0 and at > 0:
            at = min(at, bisect_right(sizes, room))
            if at:
                at -= 1
                size = sizes[at]
                uses[size] = min(left[size], room // size)
                room -= uses[size] * size
        times = min(left[s] // n for s, n in uses.items())
        plan.append((times, uses))
        for s, n in uses.items():
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect_left(sizes, s)]
    return plan


def empty_room(plan: list[tuple[int, dict[int, int]]], capacity: int) -> int:
    """What a bucket's batches leave empty, but for its emptiest one: some batch has to be the last."""
    rooms = [(capacity - sum(s * n for s, n in uses.items()), times) for times, uses in plan]
    return sum(room * times for room, times in rooms) - max((room for room, _ in rooms), default=0)


def _inside(histogram: dict[int, int], low: int, high: int) -> dict[int, int]:
    return {s: n for s, n in histogram.items() if low < s <= high}


def bucket_bounds(histogram: dict[int, int], capacity: int, buckets: int, cuts: int = CUTS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding."""
    sizes = sorted(histogram)
    if not sizes:
        return []
    weight = np.cumsum([s * histogram[s] for s in sizes], dtype=np.float64)
    places = np.searchsorted(weight, weight[-1] * np.arange(1, cuts + 1) / (cuts + 1))
    ends = [0, *sorted({sizes[int(i)] for i in places} | {sizes[-1]})]
    m, k = len(ends) - 1, max(1, min(buckets, len(ends) - 1))

    def cost(i: int, j: int) -> float:
        own = _inside(histogram, ends[i], ends[j])
        return empty_room(_batches(own, capacity), capacity) + PAD_WEIGHT * sum((ends[j] - s) * n for s, n in own.items())

    costs = {(i, j): cost(i, j) for i in range(m) for j in range(i + 1, m + 1)}
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(0, 0): (0.0, [])}
    for b in range(1, k + 1):
        for j in range(b, m + 1):
            ways = [(best[b - 1, i][0] + costs[i, j], [*best[b - 1, i][1], ends[j]]) for i in range(b - 1, j) if (b - 1, i) in best]
            best[b, j] = min(ways)
    return min(best[b, m] for b in range(1, k + 1))[1]


def batch_plan(histogram: dict[int, int], capacity: int, buckets: int = 4) -> list[tuple[int, dict[int, int]]]:
    """Batches of all buckets, each of items of one bucket only."""
    held = {s: n for s, n in histogram.items() if n > 0}
    bounds = bucket_bounds(held, capacity, buckets)
    return [batch for low, high in zip([0, *bounds], bounds) for batch in _batches(_inside(held, low, high), capacity)]


def _segments(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """For each size, runs of ranks and the containers they go to."""
    rows, used, first = [], {}, 0
    for times, uses in plan:
        for size, n in uses.items():
            start = used.get(size, 0)
            rows.append((size, start, first, n))
            used[size] = start + n * times
        first += times
    return pd.DataFrame(rows, columns=["size", "start", "first", "each"]).astype("int64")


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, buckets: int = 4) -> DataFrame:
    """``container`` (from 0), ``id_col``, ``piece_no`` (from 0) and ``size_col`` of each piece.

    An item above ``capacity`` is cut into full pieces and a rest; no other item is cut.  Items
    of size 0, null or less take no room and are spread over the containers with size 0.  Equal
    rows are items of their own; a null id is kept.  An empty input gives an empty table.
    ``items`` is read twice and should be a written table.
    """
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    pieces = F.when(size <= capacity, F.array(size)).otherwise(
        F.concat(F.array_repeat(F.lit(capacity).cast("bigint"), (size / capacity).cast("int")), F.when(size % capacity > 0, F.array(size % capacity)).otherwise(F.array().cast("array<bigint>")))
    )
    cut = items.select(F.col(id_col).alias("k"), F.posexplode(pieces).alias("piece_no", "size"))
    histogram = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    plan = batch_plan({s: n for s, n in histogram.items() if s > 0}, capacity, buckets)
    salts = 1 + max(histogram.values(), default=0) // GROUP_ROWS
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("k", "piece_no"), F.lit(salts)).cast("int"))
    offset = F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")
    offsets = cut.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")).select("size", "salt", offset.alias("offset"))
    total = max(1, sum(times for times, _ in plan))
    segments = _segments(plan)
    by_size = {int(s): g.sort_values("start") for s, g in segments.groupby("size")}
    starts = {s: g["start"].to_numpy() for s, g in by_size.items()}
    firsts = {s: g["first"].to_numpy() for s, g in by_size.items()}
    eachs = {s: g["each"].to_numpy() for s, g in by_size.items()}

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        found = np.zeros(len(sizes), dtype=np.int64)
        for s, at in sizes.groupby(sizes.to_numpy()).indices.items():
            rank = ranks.to_numpy()[at]
            if s == 0:
                found[at] = rank % total
                continue
            run = np.searchsorted(starts[s], rank, side="right") - 1
            found[at] = firsts[s][run] + (rank - starts[s][run]) // eachs[s][run]
        return pd.Series(found)

    ranked = cut.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("k", "piece_no")))
    placed = ranked.join(offsets, ["size", "salt"]).withColumn("container", container("size", F.col("r") - 1 + F.col("offset")))
    return placed.select("container", F.col("k").alias(id_col), F.col("piece_no").cast("bigint").alias("piece_no"), F.col("size").alias(size_col))


def pack_texts(docs: DataFrame, id_col: str, text_col: str, capacity: int = 2048, buckets: int = 4, **tokenizer) -> DataFrame:
    from .bpe import count_tokens

    return pack(settle(count_tokens(docs, id_col, text_col, **tokenizer), "sizes"), id_col, "n_tokens", capacity, buckets)
