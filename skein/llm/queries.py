"""Queries of the training-data operators; problem N's are named pN_..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, fusion, markup, neardup, packing, pii, repetition, scan, splitting, vectors


def _p7(spark: SparkSession, sf_dir: str, repair: bool) -> DataFrame:
    chunks, files = scan.scanned(table(spark, sf_dir, "document_chunks"), "id", "content", table(spark, sf_dir, "extracted_texts"), "file_id", "pages", repair)
    return chunks.withColumn("source_table", F.lit("document_chunks")).unionByName(files.withColumn("source_table", F.lit("extracted_texts")))


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir, True).select("source_table", "row_id", "page_no", F.array_join("kinds", ",").alias("kinds"), "repaired")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7(spark, sf_dir, False).select("source_table", "row_id", "page_no", F.explode("kinds").alias("noise_kind")).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _pii_sources(spark: SparkSession, sf_dir: str):
    return [("audit_log", table(spark, sf_dir, "audit_log"), "id", "query"), ("feedback", table(spark, sf_dir, "feedback"), "id", "comment"), ("knowledge_gaps", table(spark, sf_dir, "knowledge_gaps"), "id", "query")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_pii_sources(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(_pii_sources(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "document_chunks"), "id", "embedding")


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(table(spark, sf_dir, "document_chunks"), "id", "embedding")


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest against brute force, for every id divisible by 50."""
    return vectors.recall(table(spark, sf_dir, "document_chunks"), "id", "embedding")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf_dir, "document_chunks"), "id", "content")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "document_chunks"), "id", "content")


#: Equal weights: no lane is trusted more than another.
LANES = {"bm25_score": 1.0, "vec_score": 1.0, "rrf_score": 1.0}
CANDIDATE_KEY = ["query_id", "sub_no"]


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combined_scores(table(spark, sf_dir, "search_candidates"), CANDIDATE_KEY, "chunk_id", LANES)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top(p3_scores(spark, sf_dir), CANDIDATE_KEY, "chunk_id", 3).select(*CANDIDATE_KEY, "chunk_id")


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.ranked(p3_scores(spark, sf_dir), CANDIDATE_KEY, "chunk_id")


#: Table, id and text columns that may hold markup.
MARKED_UP = [("document_chunks", "id", "content"), ("extracted_texts", "file_id", "text")]


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [markup.markup(table(spark, sf_dir, t), i, c).select(F.lit(t).alias("source_table"), "row_id", F.array_join("kinds", ",").alias("kinds"), "clean_text") for t, i, c in MARKED_UP]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [markup.markup(table(spark, sf_dir, t), i, c, cleaned=False).select(F.lit(t).alias("source_table"), "row_id", F.explode("kinds").alias("markup_kind")) for t, i, c in MARKED_UP]
    return parts[0].unionByName(parts[1]).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "document_chunks"), "id", "content", ["section", "chunk_type"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).select("id").distinct()


def p10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_repetition(spark, sf_dir).where("repeats").select("doc_id").distinct()


def queries():
    found = [p1_found, p1_redacted, p2_found, p2_neighbours, p2_recall, p3_found, p3_ranking, p4_found, p4_clean, p5_found, p5_pieces, p6_found, p6_groups, p7_found, p7_repaired, p8_ids, p9_pack, p10_found, p10_repetition]
    return {f.__name__: f for f in found}


P3_SQL = """WITH o AS (SELECT query_id, sub_no, chunk_id, max(bm25_score) AS b, max(vec_score) AS v, max(rrf_score) AS r FROM search_candidates GROUP BY ALL),
l AS (SELECT query_id, sub_no, chunk_id, unnest([{'lane': 1, 'x': b}, {'lane': 2, 'x': v}, {'lane': 3, 'x': r}], recursive := true) FROM o),
c AS (SELECT *, x - quantile_disc(x, 0.5) OVER w AS t FROM l WINDOW w AS (PARTITION BY query_id, sub_no, lane)),
s AS (SELECT *, quantile_disc(abs(t), 0.5) OVER w AS d, avg(abs(t)) OVER w AS a, min(t) OVER w AS least FROM c WINDOW w AS (PARTITION BY query_id, sub_no, lane)),
z AS (SELECT *, CASE WHEN d > 0 THEN d * 1.4826 ELSE a * 1.2533 END AS scale FROM s),
y AS (SELECT query_id, sub_no, chunk_id, CASE WHEN coalesce(scale, 0) <= 0 THEN CASE WHEN t IS NOT NULL OR least IS NULL THEN 0.5 ELSE 0.25 END WHEN t IS NOT NULL THEN 1 / (1 + exp(-greatest(least(t / scale, 30), -30))) ELSE 0.5 / (1 + exp(-greatest(least(least / scale, 30), -30))) END AS value FROM z),
f AS (SELECT query_id, sub_no, chunk_id, round(exp(sum(ln(value)) / 3), 12) AS score FROM y GROUP BY ALL)
SELECT query_id, sub_no, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sub_no ORDER BY score DESC, chunk_id) AS place FROM f) WHERE place <= 3"""
P6_SQL = """WITH w AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS w FROM document_chunks WHERE content IS NOT NULL),
g AS (SELECT id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 40),
s AS (SELECT id, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p WHERE c >= 0.6::DOUBLE * (na + nb - c)"""


def oracle_sql():
    """For what SQL can say; the others are compared with brute force in the tests."""
    return {"p3_found": P3_SQL, "p5_found": "SELECT DISTINCT id FROM document_chunks WHERE length(content) > 1500", "p6_found": P6_SQL}
