"""Extractive answers: phrases, excerpts, packages, validity of stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import concepts as C
from ..functions import phrases
from ..functions import text as T
from . import gates


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def body(content: Column | str) -> Column:
    """A chunk's text with wrapped lines joined and a leading heading line removed."""
    joined = T.join_wrapped_lines(content)
    first = T.strip(F.substring_index(joined, "\n", 1))
    rest = T.strip(F.substr(joined, F.length(F.substring_index(joined, "\n", 1)) + 2))
    heads = (F.instr(joined, "\n") > 0) & (first != "") & (rest != "") & ~first.rlike("[.!?]$") & (F.length(first) <= 80)
    return F.when(heads, rest).otherwise(joined)


def package(evidence: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row for each question: phrase, its chunk, confidence, routing and the excerpts shown.

    ``evidence``: ``query_id``, ``question``, ``chunk_id``, ``place``, ``chunk_type``, ``content``,
    ``confidence`` and, if there is a reranker, ``rerank_score`` (null abstains).  A question's first
    ``config.evidence`` rows are its excerpts; gates follow in their fixed order: generic questions,
    relevance, scope, veto, routing.
    """
    score = F.col("rerank_score") if "rerank_score" in evidence.columns else F.lit(None).cast("double")
    rows = evidence.where(F.col("place") <= config.evidence).withColumn("_score", score)
    shown = rows.groupBy("query_id", "question").agg(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "content", "chunk_type", "confidence", "_score"))).alias("_e"))  # at most config.evidence structs
    chosen = C.arrow(lambda q, e: list(map(str, phrases.answer(q or "", [(x["content"] or "", x["chunk_type"], x["confidence"]) for x in e], config=config))), "array<string>")
    best = shown.withColumn("_a", chosen("question", "_e")).select(
        "query_id", "question", F.col("_a")[0].alias("phrase"), F.get("_e", F.greatest(F.col("_a")[1].cast("int"), F.lit(0)))["chunk_id"].alias("chunk_id"), F.col("_e")[0]["_score"].alias("_score"),
        F.transform("_e", lambda x: T.truncate(x["content"], config.excerpt_chars)).alias("excerpts"), F.col("_e")[0]["confidence"].alias("_top"),
    ).withColumn("_excerpt", F.coalesce(F.col("excerpts")[0], F.lit("")))
    terms = T.content_terms("question")
    shares = F.when(F.size(terms) > 0, F.exists(terms, lambda t: F.contains(F.lower("_excerpt"), t)))
    best = best.withColumns({"_confidence": gates.dampened("_top", C.arrow(C.without_subject, "boolean")(F.coalesce("question", F.lit(""))), F.lit(False), shares, config), "_relevance": gates.evidence_relevance("question", "phrase", "_excerpt")})
    confidence, routing = gates.gated("question", "phrase", "_relevance", "_confidence", "_score", config)
    return best.select("query_id", "chunk_id", "phrase", F.bround(confidence, 1).alias("confidence"), routing.alias("routing"), "excerpts")


def valid_cache(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored answers whose documents all have the versions they were given from.

    ``cache``: ``query_hash`` and ``doc_versions`` (map id -> version); ``documents``: ``doc_id``
    and ``version``.
    """
    wanted = cache.select("query_hash", F.explode_outer("doc_versions").alias("doc_id", "stored"))
    checked = wanted.join(documents.select("doc_id", "version"), "doc_id", "left")
    stale = checked.where(F.col("stored").isNotNull() & ~F.col("stored").eqNullSafe(F.col("version"))).select("query_hash").distinct()
    return cache.join(stale, "query_hash", "left_anti")


def cache_key(**parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def has_answer(questions: DataFrame, corpus: DataFrame, phrase: str, content: str, most: int = 1000) -> DataFrame:
    """Questions (at most ``most``, checked) of which some text holds the phrase."""
    rows = questions.select("query_id", F.lower(phrase).alias("p")).where("p is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} questions: ask in parts")
    low = F.lower(F.col(content))
    hits = [F.when(F.contains(low, F.lit(r["p"])), F.lit(r["query_id"])) for r in rows]
    found = corpus.where(F.col(content).isNotNull()).select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("query_id")).distinct() if hits else questions.limit(0)
    return questions.join(found.select("query_id"), "query_id", "left_semi")


def primary(blocks: Column | str) -> Column:
    """The best of a question's blocks (structs of ``routing`` and ``confidence``): answered ones first, then by
    confidence, then by place."""
    key = lambda b, i: F.struct(b["routing"].isin("answer", "partial").cast("int").alias("answered"), b["confidence"].alias("confidence"), (-i).alias("place"), b.alias("block"))
    return F.array_max(F.transform(_col(blocks), key))["block"]


def retried(first: Column | str, second: Column | str, config: EngineConfig = DEFAULT) -> Column:
    """The second attempt (structs of ``score``) if the first one's evidence is rejected and its own is not, and
    scores better; a missing score rejects nothing."""
    a, b = _col(first), _col(second)
    better = (a["score"] < config.veto_score) & (b["score"] >= config.veto_score) & (b["score"] > a["score"])
    return F.when(F.coalesce(better, F.lit(False)), b).otherwise(a)
