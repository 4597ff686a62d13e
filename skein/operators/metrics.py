"""Retrieval metrics over rankings (query_id, chunk_id, place) and judgements (query_id, chunk_id).

Every judged or ranked query of ``queries`` counts: with nothing relevant it is a hit with full
recall, counts 0 in reciprocal rank and precision, and is left out of nDCG.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(queries: DataFrame, ranking: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """One row for each k: hit rate, MRR, mean precision, recall and nDCG; the ranking meets the judgements once."""
    gold = relevant.select("query_id", "chunk_id").distinct()
    size = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    inside = lambda k, x: F.when(F.col("place") <= k, x)
    sums = [c for k in ks for c in (F.count(inside(k, F.lit(1))).alias(f"h{k}"), F.min(inside(k, F.col("place"))).alias(f"f{k}"), F.sum(inside(k, 1 / F.log2(F.col("place") + 1))).alias(f"d{k}"))]
    hits = ranking.where(F.col("place") <= max(ks)).join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(*sums)
    base = queries.select("query_id").distinct().join(size, "query_id", "left").join(hits, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    spread = base.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h"), F.col(f"f{k}").alias("first"), F.coalesce(f"d{k}", F.lit(0.0)).alias("dcg")) for k in ks])).alias("x")).select("n", "x.*")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", "k"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    none = F.col("n") == 0
    own = {
        "hit": F.when(none | (F.col("h") > 0), 1.0).otherwise(0.0), "rr": F.coalesce(1 / F.col("first"), F.lit(0.0)), "precision": F.col("h") / F.col("k"),
        "recall": F.when(none, 1.0).otherwise(F.col("h") / F.col("n")), "ndcg": F.when(~none, F.least(F.lit(1.0), F.col("dcg") / ideal)),
    }
    return spread.groupBy("k").agg(*[F.round(F.avg(v), 6).alias(c) for c, v in own.items()])


def average_precision(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mean of the running precision at relevant places, over the number retrieved."""
    from pyspark.sql import Window

    marked = ranking.join(relevant.select("query_id", "chunk_id", F.lit(1).alias("rel")).distinct(), ["query_id", "chunk_id"], "left").fillna(0, ["rel"])
    run = F.sum("rel").over(Window.partitionBy("query_id").orderBy("place"))
    return marked.withColumn("p", F.when(F.col("rel") == 1, run / F.col("place")).otherwise(0.0)).groupBy("query_id").agg(F.round(F.sum("p") / F.count(F.lit(1)), 6).alias("mean_precision"))


def processing_accuracy(answers: DataFrame) -> DataFrame:
    """Shares of questions processed as expected: ``intents`` all equal to ``expected_intent`` (unless that
    is "general"), ``entities`` that hold all of ``expected_entities``, and as many parts as expected."""
    intent = (F.col("expected_intent") == "general") | F.forall("intents", lambda x: x == F.col("expected_intent"))
    entity = F.size(F.array_except("expected_entities", "entities")) == 0
    parts = F.size("intents") == F.col("expected_parts")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return answers.agg(F.count(F.lit(1)).alias("n"), share(intent).alias("intent"), share(entity).alias("entity"), share(parts).alias("parts"), share(intent & entity & parts).alias("all"))


def graded(cases: DataFrame) -> DataFrame:
    """``cases`` with ``passed``: ``kind`` "none" wants no block answered, "each" every pattern in some
    answered block, "all" every pattern in the first answered block; ``blocks`` are structs of ``routing``
    and ``text``, patterns meet any case."""
    texts = F.transform(F.filter("blocks", lambda b: b["routing"].isin("answer", "partial")), lambda b: b["text"])
    meets = lambda t, p: F.regexp_like(t, F.concat(F.lit("(?i)"), p))
    each = F.forall("patterns", lambda p: F.exists(texts, lambda t: meets(t, p)))
    every = (F.size(texts) > 0) & F.forall("patterns", lambda p: F.coalesce(meets(F.try_element_at(texts, F.lit(1)), p), F.lit(False)))
    return cases.withColumn("passed", F.when(F.col("kind") == "none", F.size(texts) == 0).when(F.col("kind") == "each", each).otherwise(every))
