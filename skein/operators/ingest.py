"""From read files to rows of the store: documents, chunks, entity edges, aliases; and their sinks."""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T
from ..functions.concepts import arrow
from ..sources import chunking, harvest, metadata, ocr
from . import store


class Ingested(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    edges: DataFrame
    aliases: DataFrame


def mentioned(text: Column | str, dictionary: DataFrame, types: list[str]) -> Column:
    """Canonicals of some types of which an alias is a substring; the dictionary (alias, canonical, type)
    is small by nature, and is checked to be (10,000 rows)."""
    rows = dictionary.where(F.col("type").isin(types)).select(F.lower("alias").alias("alias"), "canonical", "type").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the dictionary is too large for substring tests in each row; use retrieval.entity_edges")
    low = F.lower(T._c(text))
    hits = [F.when(F.contains(low, F.lit(r["alias"])), F.struct(F.lit(r["canonical"]).alias("entity"), F.lit(r["type"]).alias("entity_type"))) for r in rows if r["alias"]]
    return F.array_distinct(F.filter(F.array(*hits) if hits else F.array().cast("array<struct<entity:string,entity_type:string>>"), lambda x: x.isNotNull()))


def ingest(files: DataFrame, dictionary: DataFrame, known_hashes: DataFrame | None = None, first_id: int = 1, types: list[str] = ("lender", "product", "document", "property"), config: EngineConfig = DEFAULT) -> Ingested:
    """``files``: ``path``, ``source_format``, ``text``, ``pages``, ``error`` and ``sidecar`` (JSON or null).

    Files with an error, and files without chunks, give no document.  Documents are unapproved and
    numbered from ``first_id`` by path; a content hash that ``known_hashes`` or an earlier chunk has
    is skipped.  With ``config.embed`` chunks get an ``embedding``.
    """
    good = files.where("error is null").withColumn("_side", metadata.read_sidecar("sidecar"))
    docs = metadata.resolve(good, "path", "text", "_side").withColumnRenamed("path", "source_path")
    cut = chunking.chunk_table(docs, "source_path", "text", "pages", config.excerpt_chars // 2, config.chunk_min_tokens)
    held = numbered(docs.join(cut.select("source_path").distinct(), "source_path", "left_semi"), "source_path", "doc_id", first_id)
    documents = held.select("doc_id", "title", "source_path", "doc_type", "department", "client_id", "uploaded_by", F.lit(True).alias("is_active"), F.lit(False).alias("is_approved"), F.lit(1).alias("version"))
    chunks = cut.join(held.select("source_path", "doc_id", "department", "client_id"), "source_path").withColumn("content_hash", T.content_hash("content"))
    fresh = chunks.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "content_hash"]), F.struct("doc_id", "chunk_no")).alias("_r")).select("content_hash", "_r.*")
    if known_hashes is not None:
        fresh = fresh.join(known_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
    text = arrow(harvest.summary, "string")
    fresh = fresh.select("doc_id", "chunk_no", "content", "content_hash", "section", "chunk_type", "page_number", "department", "client_id", text("content").alias("summary"), F.lit(True).alias("is_active"), F.lit(False).alias("is_approved"))
    if config.embed:
        fresh = fresh.withColumn("embedding", embedded("content", config, "search_document: "))
    edges = fresh.select("doc_id", "chunk_no", F.explode(mentioned("content", dictionary, list(types))).alias("e")).select("doc_id", "chunk_no", "e.entity", "e.entity_type")
    found = harvest.acronym_table(fresh.select("doc_id", "content"), "doc_id", "content")
    return Ingested(documents, fresh, edges, found.groupBy("alias").agg(F.min_by("canonical", F.struct("doc_id", "canonical")).alias("canonical"), F.min("doc_id").alias("document_id")))


def numbered(df: DataFrame, order: str, name: str, first: int) -> DataFrame:
    """Ids in the order of a column, from counts per range partition: no task sees all rows."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # a row for each partition
    return ranged.withColumn("_i", F.row_number().over(w)).join(F.broadcast(counts), "_p").withColumn(name, F.col("_i") + F.col("_before") + (first - 1)).drop("_p", "_i", "_n", "_before")


def embedded(text: str, config: EngineConfig, prefix: str) -> Column:
    """Vectors of texts by ``config.embed``, a batch at a time, each text behind a prefix."""
    embed = config.embed

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed([prefix + (t or "") for t in texts])])

    return run(text)


def sink(rows: DataFrame, path: str, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Appends ``rows`` to the table at ``path``, without those whose ``key`` stands there; gives what was added."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path)
    except Exception as e:  # the table is made by the first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    new = rows if key is None else store.insert_new(there if there is not None else rows.limit(0), rows, key, order or key)
    new.write.mode("append").parquet(path)
    return new


def gap_rows(requests: DataFrame, floor: float = 50.0) -> DataFrame:
    """Requests whose confidence is missing or below the floor."""
    return requests.where(F.col("confidence").isNull() | (F.col("confidence") < floor))


def feedback_rows(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("rating").isin(-1, 1))


def audit_rows(requests: DataFrame) -> DataFrame:
    """One row a request with defaults: a response id where there is none, empty lists, at most 25 ids."""
    return requests.select(
        "user_id", "query", F.coalesce("sub_queries", F.array().cast("array<string>")).alias("sub_queries"), F.slice(F.coalesce("retrieved_ids", F.array().cast("array<bigint>")), 1, DEFAULT.rerank_pool).alias("retrieved_ids"),
        "confidence", F.coalesce("response_id", F.substring(F.sha2(F.concat_ws(":", "user_id", "query", F.col("created_at").cast("string")), 256), 1, 16)).alias("response_id"), "outcome", "latency_ms", "created_at",
    )


def cleaned_files(files: DataFrame) -> DataFrame:
    """Files with the repairs of optical recognition on their pages and text."""
    pages = ocr.clean_pages("pages")
    return files.withColumn("pages", pages).withColumn("text", F.array_join("pages", "\n"))
