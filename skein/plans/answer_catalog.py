"""Catalogue entries of answers, roles, caches and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, ingest, retrieval, scope, store
from ..session import table
from ..sources import metadata
from .catalog import flagship, query, questions


@query()
def answer_packages(spark, sf_dir):
    chunks = table(spark, sf_dir, "document_chunks").select(F.col("id").alias("chunk_id"), "content", "chunk_type")
    evidence = flagship(spark, sf_dir).drop("routing").join(questions(spark).withColumnRenamed("text", "question"), "query_id").join(chunks, "chunk_id")
    return answers.package(evidence)


_PHRASES = [(1, "pension summary"), (2, "rate lock"), (3, "this phrase is nowhere"), (4, "escrow officer")]


@query("SELECT query_id::BIGINT AS query_id, phrase FROM (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in _PHRASES) + ") v(query_id, phrase) WHERE EXISTS (SELECT 1 FROM document_chunks WHERE contains(lower(content), lower(phrase)))")
def exists_answerable(spark, sf_dir):
    return answers.has_answer(spark.createDataFrame(_PHRASES, "query_id bigint, phrase string"), table(spark, sf_dir, "document_chunks"), "phrase", "content")


@query("SELECT a.id FROM (SELECT DISTINCT id, retrieved_ids FROM audit_log WHERE outcome = 'cached') a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(a.retrieved_ids) AS r) x LEFT JOIN documents d ON d.doc_id = x.r WHERE d.version IS DISTINCT FROM 1)")
def valid_cache(spark, sf_dir):
    """Cached answers that were stored with version 1 of each document."""
    a = table(spark, sf_dir, "audit_log").where("outcome = 'cached'").select("id", "retrieved_ids").distinct()
    cache = a.select(F.col("id").alias("query_hash"), F.map_from_arrays(F.array_distinct("retrieved_ids"), F.transform(F.array_distinct("retrieved_ids"), lambda _: F.lit(1))).alias("doc_versions"))
    return answers.valid_cache(cache, table(spark, sf_dir, "documents")).select(F.col("query_hash").alias("id"))


@query("SELECT id, CASE WHEN role IN ('manager', 'underwriter', 'compliance') THEN 'processor' ELSE role END AS role FROM users")
def role_collapse(spark, sf_dir):
    return store.update_where(table(spark, sf_dir, "users").select("id", "role"), F.col("role").isin("manager", "underwriter", "compliance"), role=F.lit("processor"))


@query("SELECT id, coalesce(list_position(['client', 'processor', 'admin', 'super_admin'], role), 0) >= 3 AND role <> 'client' AS allowed FROM users WHERE role IS NOT NULL")
def role_ladder(spark, sf_dir):
    return table(spark, sf_dir, "users").where("role is not null").select("id", scope.at_least("role", "admin").alias("allowed"))


@query("SELECT id, is_active IS NULL OR is_active AS show FROM users ORDER BY id")
def settings_default(spark, sf_dir):
    return table(spark, sf_dir, "users").select("id", F.coalesce("is_active", F.lit(True)).alias("show")).orderBy("id")


@query("SELECT id, len(list_intersect(coalesce(assigned_clients, []), ['CL-0001', 'CL-0002']))::INT AS shared, len(list_distinct(list_concat(coalesce(assigned_clients, []), ['CL-0001'])))::INT AS either FROM users")
def set_algebra(spark, sf_dir):
    own = F.coalesce("assigned_clients", F.array().cast("array<string>"))
    return table(spark, sf_dir, "users").select("id", F.size(F.array_intersect(own, F.array(F.lit("CL-0001"), F.lit("CL-0002")))).alias("shared"), F.size(F.array_union(own, F.array(F.lit("CL-0001")))).alias("either"))


@query("SELECT id, sha256(to_json({'query': lower(query), 'user': user_id})) AS key FROM (SELECT DISTINCT id, user_id, query FROM audit_log WHERE user_id IS NOT NULL AND query IS NOT NULL)")
def cache_keys(spark, sf_dir):
    return _keys(table(spark, sf_dir, "audit_log"))


def _keys(audited):
    a = audited.where("user_id is not null and query is not null").select("id", "user_id", "query").distinct()
    return a.select("id", answers.cache_key(query=F.lower("query"), user=F.col("user_id")).alias("key"))


@query("SELECT department, lower(trim(doc_type)) AS doc_type, count(*) AS n FROM documents GROUP BY ALL")
def document_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("department", F.lower(F.trim("doc_type")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, embedding IS NULL AS missing FROM document_chunks WHERE embedding IS NULL OR len(embedding) <> 64")
def backfill_candidates(spark, sf_dir):
    return table(spark, sf_dir, "document_chunks").where("embedding is null or size(embedding) <> 64").select("id", F.col("embedding").isNull().alias("missing"))


@query()
def grounded_summaries(spark, sf_dir):
    """Whether each chunk's stored summary is supported by its content."""
    return table(spark, sf_dir, "document_chunks").where("summary is not null").select("id", T.grounded("summary", "content").alias("grounded"))


# --- pages, lists and writes ---------------------------------------------------------------


@query("SELECT g.id, g.query, u.email FROM (SELECT DISTINCT id, query, acknowledged_by, created_at FROM knowledge_gaps) g LEFT JOIN users u ON u.id = g.acknowledged_by ORDER BY g.created_at DESC, g.id DESC LIMIT 100")
def gaps_page(spark, sf_dir):
    """The newest gaps with the address of who acknowledged them."""
    g = table(spark, sf_dir, "knowledge_gaps").select("id", "query", "acknowledged_by", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("id")).limit(100)  # the feature: one page
    return _with_email(spark, sf_dir, g, "acknowledged_by").select("id", "query", "email")


@query("SELECT f.id, f.rating, u.email FROM (SELECT DISTINCT id, user_id, rating, created_at FROM feedback) f LEFT JOIN users u ON u.id = f.user_id ORDER BY f.created_at DESC, f.id DESC LIMIT 50 OFFSET 100")
def feedback_page(spark, sf_dir):
    f = table(spark, sf_dir, "feedback").select("id", "user_id", "rating", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("id")).offset(100).limit(50)  # the feature: one page
    return _with_email(spark, sf_dir, f, "user_id").select("id", "rating", "email")


def _with_email(spark, sf_dir, rows, key):
    return rows.join(table(spark, sf_dir, "users").select(F.col("id").alias(key), "email"), key, "left")


@query("SELECT id, outcome, round(confidence, 6) AS confidence FROM (SELECT DISTINCT id, outcome, confidence, created_at FROM audit_log) ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_requests(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").select("id", "outcome", "confidence", "created_at").distinct()
    return a.orderBy(F.desc("created_at"), F.desc("id")).limit(10).select("id", "outcome", F.round("confidence", 6).alias("confidence"))  # the feature: the ten newest


@query("SELECT id, email, role FROM users ORDER BY id")
def users_list(spark, sf_dir):
    return table(spark, sf_dir, "users").select("id", "email", "role").orderBy("id")


@query("SELECT doc_id, title FROM documents WHERE uploaded_by = 17 ORDER BY created_at DESC, doc_id DESC LIMIT 50")
def own_documents(spark, sf_dir):
    """The caller's own uploads, newest first."""
    d = table(spark, sf_dir, "documents").where("uploaded_by = 17")
    return d.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(50).select("doc_id", "title")  # the feature: one page


@query("SELECT id, CASE WHEN id % 4 = 0 THEN id % 8 = 0 ELSE coalesce(is_active, true) END AS show FROM users")
def settings_upsert(spark, sf_dir):
    """Every fourth user sets the flag, every eighth to true; the others keep what they have."""
    u = table(spark, sf_dir, "users")
    old = u.select("id", F.coalesce("is_active", F.lit(True)).alias("show"), F.lit(1).alias("at"))
    new = u.where("id % 4 = 0").select("id", (F.col("id") % 8 == 0).alias("show"), F.lit(2).alias("at"))
    return store.upsert(old, new, ["id"], "at").select("id", "show")


@query("SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY file_id) AS doc_id, file_id, false AS is_approved FROM (SELECT DISTINCT file_id FROM extracted_texts WHERE source_format = 'pdf')")
def documents_inserted(spark, sf_dir):
    """Files of one format get unapproved documents, numbered after the last."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    files = table(spark, sf_dir, "extracted_texts").where("source_format = 'pdf'").select("file_id").distinct()
    return ingest.numbered(files, "file_id", "doc_id", last + 1).select("doc_id", "file_id", F.lit(False).alias("is_approved"))


@query("SELECT s.query_id, s.sub_no, s.chunk_id, coalesce(d.title, '') AS title, coalesce(d.version, 1) AS version FROM (SELECT DISTINCT query_id, sub_no, chunk_id, document_id FROM search_candidates) s LEFT JOIN documents d ON d.doc_id = s.document_id")
def candidate_metadata(spark, sf_dir):
    s = table(spark, sf_dir, "search_candidates").select("query_id", "sub_no", "chunk_id", "document_id").distinct()
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "title", "version")
    return s.join(d, "document_id", "left").select("query_id", "sub_no", "chunk_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("version", F.lit(1)).alias("version"))


@query("""WITH t AS (SELECT id, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> '') AS t FROM (SELECT DISTINCT id, query FROM knowledge_gaps WHERE query IS NOT NULL)),
g AS (SELECT id, unnest(list_concat(t, list_transform(generate_series(1, greatest(len(t) - 1, 0)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(generate_series(1, greatest(len(t) - 2, 0)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS alias FROM t),
a AS (SELECT DISTINCT array_to_string(list_filter(regexp_split_to_array(lower(alias), '[^a-z0-9]+'), lambda w: w <> ''), ' ') AS alias, canonical FROM term_aliases),
m AS (SELECT DISTINCT id, canonical FROM g JOIN a USING (alias) WHERE alias <> '')
SELECT id, canonical, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(canonical) DESC, canonical) AS place FROM m) WHERE place <= 20""")
def alias_lookup(spark, sf_dir):
    """Up to 20 canonicals of the aliases in a question, the longest first."""
    q = table(spark, sf_dir, "knowledge_gaps").where("query is not null").select("id", "query").distinct()
    found = retrieval.entity_edges(q, "id", "query", table(spark, sf_dir, "term_aliases")).withColumnRenamed("chunk_id", "id")
    w = Window.partitionBy("id").orderBy(F.desc(F.length("canonical")), "canonical")
    return found.select("id", "canonical", F.row_number().over(w).alias("place")).where("place <= 20")  # the feature: the longest 20


@query("SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM (SELECT DISTINCT id, user_id, created_at FROM audit_log WHERE user_id IS NOT NULL AND created_at >= TIMESTAMP '2024-06-01')) WHERE n <= 30")
def recent_conversations(spark, sf_dir):
    """Of each user the 30 newest entries within their time to live."""
    a = table(spark, sf_dir, "audit_log").where("user_id is not null and created_at >= timestamp_ntz'2024-06-01'").select("id", "user_id", "created_at").distinct()
    return a.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))).where("n <= 30").select("user_id", "id")  # the feature: 30 a user


@query("SELECT id, list_sort(list_filter(coalesce(allowed_departments, []), lambda x: x <> 'general')) = [] AS only_general, coalesce(list_has_all(['general', 'underwriting', 'compliance'], allowed_departments), false) AS subset FROM users")
def set_tests(spark, sf_dir):
    own = F.coalesce("allowed_departments", F.array().cast("array<string>"))
    known = F.array(*[F.lit(x) for x in ("general", "underwriting", "compliance")])
    return table(spark, sf_dir, "users").select("id", (F.size(F.array_except(own, F.array(F.lit("general")))) == 0).alias("only_general"), F.coalesce(F.size(F.array_except("allowed_departments", known)) == 0, F.lit(False)).alias("subset"))


@query("SELECT id, CASE WHEN role IN ('client', 'processor', 'admin', 'super_admin') THEN CASE WHEN role = 'client' THEN false ELSE list_position(['client', 'processor', 'admin', 'super_admin'], role) >= 2 END ELSE false END AS allowed FROM users")
def staff_allowed(spark, sf_dir):
    return table(spark, sf_dir, "users").select("id", scope.at_least("role", "processor").alias("allowed"))


@query("SELECT id, CASE WHEN doc_type IN ('policy', 'procedure', 'glossary', 'underwriting', 'eligibility', 'compliance', 'product_guide', 'system_guide', 'sop') THEN doc_type ELSE 'policy' END AS doc_type FROM (SELECT doc_id AS id, lower(trim(doc_type)) AS doc_type FROM documents)")
def categories_resolved(spark, sf_dir):
    kind = F.lower(F.trim("doc_type"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(metadata.valid(kind, metadata.DOC_TYPES), kind).otherwise("policy").alias("doc_type"))
