"""Ordered operators that no hot key turns into one task: ranges of the order, not keys, are the tasks.

Rows are range-partitioned by (key, order) and written, so that a key with a third of all rows spans
many ranges; what crosses the end of a range comes from one row for each (range, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where null equals null."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_r_{k}"])
    return left.join(right, condition, "left").drop(*[f"_r_{k}" for k in keys])


def _spread(df: DataFrame, order: list) -> DataFrame:
    return settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and exact percentiles by linear interpolation, a column for each of ``shares``.

    Null values do not count; a group of nulls only has null percentiles.
    """
    kept = df.select(group, F.col(value).cast("double").alias("_v"))
    spread = _spread(kept.where("_v is not null"), [group, "_v"])
    counts = spread.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group)
    before = counts.select("_part", group, (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))
    inner = spread.withColumn("_r", F.row_number().over(Window.partitionBy("_part", group).orderBy("_v")))
    placed = _same(inner, before, ["_part", group]).withColumn("_at", F.col("_r") - 1 + F.col("_before"))

    def one(share: float) -> Column:
        h = F.lit(share) * (F.col("_total") - 1)
        low = F.floor(h)
        return F.sum(F.when(F.col("_at") == low, F.col("_v") * (1 - (h - low))).when(F.col("_at") == low + 1, F.col("_v") * (h - low)))

    found = placed.groupBy(group).agg(*[one(p).alias(name) for name, p in shares.items()])
    return _same(kept.select(group).distinct(), found, [group])


def previous(df: DataFrame, key: str, order: list[str], value: str, name: str = "previous") -> DataFrame:
    """``df`` with the ``value`` of the row before in each key, null for its first row."""
    spread = _spread(df, [key, *order])
    inside = Window.partitionBy("_part", key).orderBy(*order)
    rows = spread.withColumns({"_own": F.lag(value).over(inside), "_r": F.row_number().over(inside)})
    ends = spread.groupBy("_part", key).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = ends.select("_part", key, F.lag("_last").over(Window.partitionBy(key).orderBy("_part")).alias("_carried"))
    return _same(rows, carried, ["_part", key]).withColumn(name, F.when(F.col("_r") == 1, F.col(f"_carried.{value}")).otherwise(F.col("_own"))).drop("_part", "_own", "_r", "_carried")


def window_count(df: DataFrame, key: str, seconds: str, width: int, name: str) -> DataFrame:
    """``df`` with how many rows of the key lie in the ``width`` seconds up to each row, itself included.

    Tasks are (key, stretch of ``width`` seconds); each row is also sent to the next stretch as context.
    """
    at = F.floor(F.col(seconds) / width)
    sent = df.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_stretch", F.when(F.col("_own"), at).otherwise(at + 1))
    w = Window.partitionBy(key, "_stretch").orderBy(seconds).rangeBetween(-width, 0)
    return sent.withColumn(name, F.count(F.lit(1)).over(w)).where("_own").drop("_own", "_stretch")
