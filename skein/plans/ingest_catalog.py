"""Catalogue entries of ingestion, conversation and streaming operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dialogue
from ..functions import text as T
from ..functions.concepts import arrow
from ..operators import ordered
from ..session import settle, table
from ..sources import chunking, harvest
from ..streaming import ingest as streams
from ..streaming import limiter
from .catalog import WS, query, sql_strip


@query()
def structural_chunks(spark, sf_dir):
    """Every extracted file, by pages where it has them."""
    return chunking.chunk_table(table(spark, sf_dir, "extracted_texts"), "file_id", "text", "pages")


@query()
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_table(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


@query()
def acronyms(spark, sf_dir):
    return harvest.acronym_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def summaries(spark, sf_dir):
    return harvest.summarise(table(spark, sf_dir, "document_chunks"), "id", "content")


@query("SELECT id, len(string_split(content, chr(10)))::INT AS n, len(list_filter(string_split(content, chr(10)), lambda s: regexp_matches(s, '^([-*]\\s|\\d+[.)]\\s)')))::INT AS items FROM document_chunks WHERE content IS NOT NULL")
def list_items(spark, sf_dir):
    lines = F.split("content", "\n")
    return table(spark, sf_dir, "document_chunks").where("content is not null").select("id", F.size(lines).alias("n"), F.size(F.filter(lines, T.is_list_item)).alias("items"))


@query(f"SELECT id, len(list_filter(list_transform(string_split(content, chr(10)), lambda s: {sql_strip('s')}), lambda s: length(s) BETWEEN 1 AND 80 AND NOT regexp_matches(s, '[.!?]$')))::INT AS headings FROM document_chunks WHERE content IS NOT NULL")
def heading_lines(spark, sf_dir):
    return table(spark, sf_dir, "document_chunks").where("content is not null").select("id", F.size(F.filter(F.split("content", "\n"), T.is_short_heading)).alias("headings"))


@query(f"SELECT file_id, p.n::INT AS page_no, regexp_replace(p.t, '(^|\\n)[ \\t]*[e•·o©][ \\t]+([^{WS}])', '\\1- \\2', 'g') AS cleaned FROM (SELECT file_id, unnest(list_transform(pages, lambda t, i: {{'t': t, 'n': i}})) AS p FROM extracted_texts) WHERE p.t IS NOT NULL")
def bullet_repair(spark, sf_dir):
    return _repaired(_pages(spark, sf_dir))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "extracted_texts").select("file_id", F.posexplode("pages").alias("i", "t")).where("t is not null")


def _repaired(pages):
    return pages.select("file_id", (F.col("i") + 1).alias("page_no"), T.repair_bullets("t").alias("cleaned"))


@query()
def sub_questions(spark, sf_dir):
    """Distinct audited questions, normalised and split."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dialogue.split_questions(t, most=10**9)[0])

    q = table(spark, sf_dir, "audit_log").where("query is not null").select("query").distinct()
    parts = q.select("query", split(T.normalize("query")).alias("parts"))
    most = DEFAULT.max_sub_queries
    return parts.select("query", (F.size("parts") > most).alias("truncated"), F.posexplode(F.slice("parts", 1, most)).alias("sub_no", "sub_query"))  # the feature: so many parts, and whether there were more


@query()
def spelling(spark, sf_dir):
    """Questions corrected against the words that many chunks use."""
    chunks = table(spark, sf_dir, "document_chunks").where("content is not null")
    counts = chunks.select(F.explode(F.array_distinct(F.filter(F.split(F.lower("content"), "[^a-z]+"), lambda w: F.length(w) > 3))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts, "words")
    total = chunks.count()
    words = [r["w"] for r in counts.where(F.col("n") >= max(3.0, total / 200)).collect()]  # at most 200 times a chunk's words: the targets
    asked = table(spark, sf_dir, "knowledge_gaps").where("query is not null").select(F.explode(F.split(T.normalize("query"), "[^a-z]+")).alias("w")).distinct()
    corpus = frozenset(r["w"] for r in asked.join(counts, "w", "left_semi").limit(200_001).collect())  # words of questions that any chunk has are left alone
    if len(corpus) > 200_000:
        raise ValueError("too many words for one list: correct by parts")
    speller = dialogue.Speller(words, corpus=corpus)

    @F.pandas_udf("string")
    def correct(texts: pd.Series) -> pd.Series:
        return texts.map(speller.correct)

    gaps = table(spark, sf_dir, "knowledge_gaps").where("query is not null").select("query").distinct()
    return gaps.select("query", correct(T.normalize("query")).alias("corrected"))


@query()
def query_entities(spark, sf_dir):
    """Dictionary terms and numbers in questions; the dictionary is a small table by nature."""
    rows = table(spark, sf_dir, "term_aliases").select("alias", "canonical").collect()
    dictionary = {r["alias"].lower(): (r["canonical"], "term") for r in rows if r["alias"] and r["canonical"]}

    @F.pandas_udf("array<struct<canonical:string,matched:string,start:int>>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"canonical": c, "matched": m, "start": a} for c, _, m, a, _ in dialogue.entities(t, dictionary)])

    q = table(spark, sf_dir, "audit_log").where("query is not null").select("query").distinct()
    return q.select("query", F.explode(find(F.lower("query"))).alias("e")).select("query", "e.canonical", "e.matched", "e.start")


@query("SELECT user_id, id, lag(query) OVER (PARTITION BY user_id ORDER BY created_at, id) AS previous FROM (SELECT DISTINCT id, user_id, query, created_at FROM audit_log WHERE user_id IS NOT NULL)")
def previous_turn(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").where("user_id is not null").select("id", "user_id", "query", "created_at").distinct()
    return ordered.previous(a, "user_id", ["created_at", "id"], "query").select("user_id", "id", "previous")


@query()
def follow_ups(spark, sf_dir):
    """Each user's questions with what refers to the question before replaced by its subject."""
    a = table(spark, sf_dir, "audit_log").where("user_id is not null and query is not null").select("id", "user_id", "query", "created_at").distinct()
    pairs = ordered.previous(a, "user_id", ["created_at", "id"], "query")
    asked = pairs.select("id", "query", arrow(dialogue.subject_of, "string")(T.normalize("previous")).alias("subject"), arrow(dialogue.self_contained, "boolean")("query").alias("own"))
    return asked.select("id", dialogue.follow_up("query", "subject", "own").alias("resolved"))


@query()
def login_limiter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.col("ts").cast("timestamp").cast("double")).withColumn("bad", F.col("event_type") == "error")
    return limiter.limit(e, "user_id", "s", "bad", "event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, outcome, count(*) AS n FROM audit_log WHERE created_at IS NOT NULL GROUP BY ALL")
def windowed_outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "audit_log").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return streams.windowed_outcomes(rows, "created_at", "outcome")
