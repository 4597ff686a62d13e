"""Lexical, vector and entity lanes over a chunk table, for batches of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def postings(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``lexeme``, ``chunk_id``, ``n`` positions: the inverted index, worth storing by lexeme."""
    return chunks.select(F.col(id_col).alias("chunk_id"), F.explode(T.plain_tokens(text_col)).alias("lexeme")).groupBy("lexeme", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


def lexical_hits(questions: DataFrame, chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id``, ``chunk_id``, ``lex``: a tenth of the positions any prefix of a question
    matches.

    Prefixes meet the distinct lexemes by their first character and are then checked, so the
    big table only joins on whole lexemes, by equality.
    """
    wanted = questions.select("query_id", F.explode(T.prefixes("text")).alias("prefix"))
    index = postings(chunks, id_col, text_col)
    lexemes = index.select("lexeme").distinct().withColumn("head", F.left("lexeme", F.lit(1)))
    matched = wanted.withColumn("head", F.left("prefix", F.lit(1))).join(lexemes, "head").where(F.startswith("lexeme", "prefix")).select("query_id", "lexeme").distinct()
    return matched.join(index, "lexeme").groupBy("query_id", "chunk_id").agg((F.sum("n") * F.lit(0.1)).alias("lex"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; null where a norm is zero or lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


#: So many question variants go to all tasks at once; a larger batch is asked in parts.
MOST_VARIANTS = 10_000
#: A dictionary of at most so many aliases is looked up inside the row.
MOST_ALIASES = 10_000


def _variants(questions: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """The questions' ids in order, the first row of each, and all unit vectors by question."""
    rows = questions.select("query_id", "embedding").where("query_id is not null and embedding is not null").limit(MOST_VARIANTS + 1).collect()
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} question vectors: ask in parts")
    rows = sorted((r for r in rows if any(r["embedding"])), key=lambda r: r["query_id"])
    ids = [r["query_id"] for r in rows]
    firsts = np.array([i for i, q in enumerate(ids) if not i or ids[i - 1] != q], dtype=np.int64)
    unit = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return [ids[i] for i in firsts], firsts, unit / np.sqrt((unit**2).sum(axis=1))[:, None] if len(rows) else unit


def _usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of ``dims`` values that is not all zero, and these at unit length."""
    good = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims)
    values = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norms = np.sqrt((values**2).sum(axis=1))
    fit = norms > 0
    return good[fit], values[fit] / norms[fit, None]


def vector_hits(questions: DataFrame, chunks: DataFrame, id_col: str, vec_col: str, floor: float | None = None, top: int | None = None) -> DataFrame:
    """``query_id``, ``chunk_id``, ``vec``: the best cosine over a question's variants.

    ``questions`` (``query_id``, ``embedding``) is a batch of checked size that all tasks get; the chunk
    table is read once, in matrix blocks, and only pairs from ``floor`` on leave a task, or with ``top``
    those that are among a block's best so many of a question (equal cosines all stay).
    """
    ids, firsts, unit = _variants(questions)
    source = chunks.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).cast("array<float>").alias("e")).where("e is not null")
    kinds = f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_id {source.schema['chunk_id'].dataType.simpleString()}, vec double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if ids else ():
            rows, vectors = _usable(batch.column(1), unit.shape[1])
            cos = np.maximum.reduceat(vectors @ unit.T, firsts, axis=1) if len(rows) else np.empty((0, len(ids)))
            keep = cos >= (-2.0 if floor is None else floor)
            if top is not None and len(rows) > top:
                keep &= cos >= np.partition(cos, len(rows) - top, axis=0)[len(rows) - top] - 1e-9
            at, q = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], pa.int64()), batch.column(0).take(pa.array(rows[at])), pa.array(cos[at, q])], names=["query_id", "chunk_id", "vec"])

    return source.mapInArrow(run, kinds).groupBy("query_id", "chunk_id").agg(F.max("vec").alias("vec"))


def vector_scores(pairs: DataFrame, questions: DataFrame, chunks: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec`` of given (``query_id``, ``chunk_id``) pairs; pairs without a usable vector are left out."""
    ids, firsts, unit = _variants(questions)
    place = {q: i for i, q in enumerate(ids)}
    held = pairs.select("query_id", "chunk_id").join(chunks.select(F.col(id_col).alias("chunk_id"), F.col(vec_col).cast("array<float>").alias("e")).where("e is not null"), "chunk_id").select("query_id", "chunk_id", "e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if ids else ():
            rows, vectors = _usable(batch.column(2), unit.shape[1])
            own = np.array([place.get(q, -1) for q in batch.column(0).take(pa.array(rows)).to_pylist()], dtype=np.int64)
            asked = np.flatnonzero(own >= 0)
            cos = np.maximum.reduceat(vectors[asked] @ unit.T, firsts, axis=1) if len(asked) else np.empty((0, len(ids)))
            at = pa.array(rows[asked])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cos[np.arange(len(asked)), own[asked]])], names=["query_id", "chunk_id", "vec"])

    types = {f.name: f.dataType.simpleString() for f in held.schema}
    return held.mapInArrow(run, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, vec double")


def admitted_vectors(lex: DataFrame, questions: DataFrame, chunks: DataFrame, id_col: str, vec_col: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Cosines of the pairs that a ranking can admit: from the floor on, and those of lexical hits."""
    near = vector_hits(questions, chunks, id_col, vec_col, config.similarity_floor)
    return near.unionByName(vector_scores(lex, questions, chunks, id_col, vec_col)).groupBy("query_id", "chunk_id").agg(F.max("vec").alias("vec"))


def entity_edges(chunks: DataFrame, id_col: str, text_col: str, dictionary: DataFrame) -> DataFrame:
    """``chunk_id``, ``canonical`` where an alias occurs in the text as whole words.

    Up to ``MOST_ALIASES`` aliases are looked up inside the row, so only hits leave it; the n-grams of a
    chunk meet a larger dictionary by an equality join.
    """
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), T.plain_tokens(text_col).alias("t"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice("t", i, n), " "))

    grams = [grams_of(n) for n in range(1, DEFAULT.alias_ngram + 1)]
    aliases = dictionary.select(F.array_join(T.plain_tokens("alias"), " ").alias("alias"), "canonical").where("alias <> ''").distinct()
    known = aliases.limit(MOST_ALIASES + 1).collect()
    if len(known) <= MOST_ALIASES:
        names = sorted({r["alias"] for r in known}) or [""]
        sizes = {n: [a for a in names if len(a.split()) == n] for n in range(1, DEFAULT.alias_ngram + 1)}
        only = lambda g, own: F.filter(g, lambda x: x.isin(own))
        grams = [only(g, own) for g, own in zip(grams, sizes.values()) if own]
    hits = F.array_distinct(F.concat(*grams)) if grams else F.array().cast("array<string>")
    spread = tokens.where(F.size("t") > 0).select("chunk_id", F.explode(hits).alias("alias"))
    return spread.join(aliases, "alias").select("chunk_id", "canonical").distinct()


def entity_hits(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id``, ``chunk_id``, ``ent``: distinct entities a chunk shares with a question."""
    return questions.join(edges, "canonical").groupBy("query_id", "chunk_id").agg(F.countDistinct("canonical").alias("ent"))


def hybrid_candidates(lex: DataFrame, vec: DataFrame, ent: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Candidates of each question by fused ranks of the three lanes.

    A chunk is admitted by a lexical hit or a cosine at the floor.  Ranks share ties; scores are
    rounded to nine places first, so that last bits do not split ties.  The entity lane adds to
    chunks with hits only.  The best ``config.candidates`` of each question remain, the smaller
    chunk id first among equals.
    """
    both = lex.join(vec, ["query_id", "chunk_id"], "full_outer")
    if ent is not None:
        both = both.join(ent, ["query_id", "chunk_id"], "left")
    else:
        both = both.withColumn("ent", F.lit(0).cast("bigint"))
    scored = both.select("query_id", "chunk_id", F.round(F.coalesce("lex", F.lit(0.0)), 9).alias("lex"), F.round(F.coalesce("vec", F.lit(-1.0)), 9).alias("vec"), F.coalesce("ent", F.lit(0)).alias("ent"))
    admitted = scored.where((F.col("lex") > 0) | (F.col("vec") >= config.similarity_floor))
    by = lambda c: F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(c)))
    k = config.rank_constant
    fused = admitted.withColumns({"r_lex": by("lex"), "r_vec": by("vec"), "r_ent": by("ent")}).withColumn(
        "score", F.round(config.lexical_weight / (k + F.col("r_lex")) + config.vector_weight / (k + F.col("r_vec")) + F.when(F.col("ent") > 0, config.entity_weight / (k + F.col("r_ent"))).otherwise(0.0), 12)
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.candidates)


def rank_fusion(a: DataFrame, b: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Weighted reciprocal-rank fusion of two (``query_id``, ``chunk_id``, ``score``) lists by
    position; a chunk missing from a list has ``config.missing_rank`` there and score 0."""

    def placed(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return df.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.row_number().over(w).alias(f"{name}_rank"))

    both = placed(a, "a").join(placed(b, "b"), ["query_id", "chunk_id"], "full_outer")
    rank = lambda c: F.coalesce(c, F.lit(config.missing_rank))
    fused = both.select(
        "query_id", "chunk_id", F.coalesce("a_score", F.lit(0.0)).alias("a_score"), F.coalesce("b_score", F.lit(0.0)).alias("b_score"), rank("a_rank").alias("a_rank"),
        F.round(config.lexical_weight / (config.rank_constant + rank("a_rank")) + config.vector_weight / (config.rank_constant + rank("b_rank")), 12).alias("rrf_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "a_rank", "chunk_id")
    return fused.withColumn("combined_rank", F.row_number().over(w)).drop("a_rank")


def linear_fusion(df: DataFrame, lexical: str, vector: str, config: EngineConfig = DEFAULT) -> DataFrame:
    return df.withColumn("score", F.round(config.lexical_weight * F.coalesce(F.col(lexical), F.lit(0.0)) + config.vector_weight * F.coalesce(F.col(vector), F.lit(0.0)), 9))


def with_fragment_penalty(score: str, content: str, config: EngineConfig = DEFAULT) -> Column:
    return F.when(T.is_fragment(content), F.col(score) * config.fragment_penalty).otherwise(F.col(score))


def rerank(ranked: DataFrame, scores: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Re-sorts the head of each ranking by outside scores; the rest keeps its order.

    ``ranked``: ``query_id``, ``chunk_id``, ``place``; ``scores``: ``query_id``, ``chunk_id``,
    ``rerank_score``.  Without scores the order stays.
    """
    joined = ranked.join(scores, ["query_id", "chunk_id"], "left").withColumn("head", (F.col("place") <= config.rerank_head) & F.col("rerank_score").isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("head"), F.when(F.col("head"), -F.col("rerank_score")), "place")
    return joined.withColumn("place", F.row_number().over(w)).drop("head")


def rerank_scores(pool: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``rerank_score`` by ``config.rerank`` (questions, contents -> scores) of each question's first
    ``config.rerank_pool`` rows (``query_id``, ``chunk_id``, ``place``, ``question``, ``content``); no rows without a model."""
    score = config.rerank
    if score is None:
        return pool.limit(0).select("query_id", "chunk_id", F.lit(None).cast("double").alias("rerank_score"))

    @F.pandas_udf("double")
    def run(asked: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series(score(list(asked), list(contents)), dtype="float64")

    return pool.where(F.col("place") <= config.rerank_pool).select("query_id", "chunk_id", run("question", "content").alias("rerank_score"))
