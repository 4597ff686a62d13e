"""One ranking from several differently-scaled scores.

Within each group a score is standardised robustly, as its distance from the median in units of
the median absolute deviation, squashed by the logistic function so that outliers saturate, and
the bounded values are combined by a weighted geometric mean.  No score's range matters: any
increasing linear change of a lane leaves the ranking as it is.

Medians come from mergeable summaries (``percentile_approx``; exact up to ``ACCURACY`` rows in a
group), so a group with a third of all rows is summarised on all executors; ranks come from
range-partitioned rows and per-partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: In a group of more rows a median may be off by one rank for every million rows.
ACCURACY = 1_000_000
#: A value's share of the logistic scale per robust standard deviation.
SLOPE = 1.0
#: What a row gets in a lane that did not return it, as a share of the lane's least value.
ABSENT = 0.5


def _median(column: Column) -> Column:
    return F.percentile_approx(column, 0.5, ACCURACY)


def combined_scores(df: DataFrame, group: list[str], item: str, lanes: dict[str, float]) -> DataFrame:
    """``group`` + ``item`` + ``score``; ``lanes`` maps score columns to their weights.

    Rows with the same group and item count once (with the largest value of each lane).  Null
    and NaN mean that the lane did not return the item: it gets half of the lane's least value
    there.  A lane without any value in a group, or with one value only, is neutral (0.5).  A
    deviation of 0 with unequal values falls back to the mean absolute deviation.  Infinite
    values count as the outliers they are.  Null group keys form a group of their own.
    """
    total = sum(lanes.values())
    once = df.groupBy(*group, item).agg(*[F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"x_{c}") for c in lanes])
    bound = lambda c: F.when(F.col(f"x_{c}").isNotNull(), F.greatest(F.least(F.col(f"x_{c}"), F.lit(1e300)), F.lit(-1e300)))
    once = once.withColumns({f"x_{c}": bound(c) for c in lanes})
    middles = once.groupBy(*group).agg(*[_median(F.col(f"x_{c}")).alias(f"m_{c}") for c in lanes])
    same = lambda left, right: _null_safe(left, right, group)
    centred = same(once, middles).withColumns({f"x_{c}": F.col(f"x_{c}") - F.col(f"m_{c}") for c in lanes}).select(*group, item, *[f"x_{c}" for c in lanes])
    spreads = centred.groupBy(*group).agg(
        *[_median(F.abs(f"x_{c}")).alias(f"d_{c}") for c in lanes],
        *[F.avg(F.abs(f"x_{c}")).alias(f"a_{c}") for c in lanes],
        *[F.min(f"x_{c}").alias(f"l_{c}") for c in lanes],
    )
    joined = same(centred, spreads)

    def squashed(x: Column, c: str) -> Column:
        scale = F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}") * 1.4826).otherwise(F.col(f"a_{c}") * 1.2533)
        z = F.greatest(F.least(x / scale, F.lit(30.0)), F.lit(-30.0))
        return F.when(F.coalesce(scale, F.lit(0.0)) <= 0, F.lit(0.5)).otherwise(1 / (1 + F.exp(-SLOPE * z)))

    def lane(c: str) -> Column:
        value = F.when(F.col(f"x_{c}").isNotNull(), squashed(F.col(f"x_{c}"), c)).when(F.col(f"l_{c}").isNull(), F.lit(0.5)).otherwise(squashed(F.col(f"l_{c}"), c) * ABSENT)
        return F.log(value) * (lanes[c] / total)

    score = lane(next(iter(lanes)))
    for c in list(lanes)[1:]:
        score = score + lane(c)
    return joined.select(*group, item, F.round(F.exp(score), 12).alias("score"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; the left side's keys are kept."""
    right = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        this = left[k].eqNullSafe(right[f"r_{k}"])
        condition = this if condition is None else condition & this
    return left.join(right, condition).drop(*[f"r_{k}" for k in keys])


def top(scores: DataFrame, group: list[str], item: str, k: int) -> DataFrame:
    """The first ``k`` of each group; equal scores: the smaller item first.

    Spark limits each partition to ``k`` rows a group before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.col(item))
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ranked(scores: DataFrame, group: list[str], item: str) -> DataFrame:
    """``place`` (bigint, from 1) for every row, however large a group is."""
    from ..session import settle

    spread = settle(scores.repartitionByRange(*group, F.desc("score"), item).withColumn("part", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(*group).orderBy("part")) - F.col("n")).drop("n")
    inner = spread.withColumn("r", F.row_number().over(Window.partitionBy("part", *group).orderBy(F.desc("score"), item)))
    return _null_safe(inner, before, ["part", *group]).select(*group, item, "score", (F.col("r") + F.col("before")).alias("place"))
