"""The query catalogue of the core engine, with its SQL oracles; every query is over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import lexicon as L
from ..functions import text as T
from ..operators import gates, ingest, metrics, ordered, retrieval, scope, store
from ..session import settle, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


#: White space in SQL patterns, as the Unicode property has it.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{WS}]+|[{WS}]+$', '', 'g')"


# --- a batch of questions ------------------------------------------------------------------

QUESTIONS = [
    (1, "who signs the payslip and the bank statement"), (2, "steps to review a gift letter"), (3, "difference between rate lock and loan estimate"), (4, "what is the limit of an escrow account"),
    (5, "documents for an aml check and a dip"), (6, "how long is an appraisal report valid"), (7, "zzyzx qwxv"), (8, ""),
]
_QUESTION_ROWS = ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)
QUESTIONS_SQL = f"SELECT CAST(c0 AS BIGINT) AS query_id, c1 AS text FROM (VALUES {_QUESTION_ROWS}) v(c0, c1)"


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id bigint, text string")


_LEX_SQL = f"""
q AS ({QUESTIONS_SQL}),
p AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS prefix FROM q),
w AS (SELECT id AS chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda w: w <> '')) AS lexeme FROM document_chunks WHERE content IS NOT NULL),
idx AS (SELECT chunk_id, lexeme, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT DISTINCT p.query_id, l.lexeme FROM p JOIN (SELECT DISTINCT lexeme FROM idx) l ON starts_with(l.lexeme, p.prefix)),
lex AS (SELECT m.query_id, idx.chunk_id, sum(idx.n) * 0.1::DOUBLE AS lex FROM m JOIN idx USING (lexeme) GROUP BY ALL)"""

#: Query vectors: chunks that serve as examples, one or two variants for a question.
_EXAMPLES = [(1, 1), (1, 7), (2, 20), (3, 33), (4, 41), (5, 58), (6, 66)]
_EXAMPLE_ROWS = ", ".join(f"({a}, {b})" for a, b in _EXAMPLES)
_COS = "list_dot_product(c.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])))"
_VEC_SQL = f"""
ex AS (SELECT e.query_id, d.embedding FROM (SELECT CAST(c0 AS BIGINT) AS query_id, CAST(c1 AS BIGINT) AS id FROM (VALUES {_EXAMPLE_ROWS}) v(c0, c1)) e JOIN document_chunks d USING (id) WHERE d.embedding IS NOT NULL),
ok AS (SELECT id, embedding FROM document_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
okx AS (SELECT * FROM ex WHERE len(embedding) = 64 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
vec AS (SELECT x.query_id, c.id AS chunk_id, max({_COS}) AS vec FROM okx x, ok c GROUP BY ALL)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame(_EXAMPLES, "query_id bigint, id bigint")
    return table(spark, sf_dir, "document_chunks").select("id", "embedding").join(wanted, "id").select("query_id", "embedding").where("size(embedding) = 64")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_chunks")


def _lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_hits(questions(spark), _chunks(spark, sf_dir).where("content is not null"), "id", "content")


def _vec(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    return retrieval.vector_hits(_examples(spark, sf_dir), _chunks(spark, sf_dir), "id", "embedding", **limits)


def _ent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that chunks share with the questions, by the dictionary."""
    asked = retrieval.entity_edges(questions(spark), "query_id", "text", table(spark, sf_dir, "term_aliases")).withColumnRenamed("chunk_id", "query_id")
    return retrieval.entity_hits(asked, _edges(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = settle(_lex(spark, sf_dir), "lex")  # used twice
    return retrieval.hybrid_candidates(lex, retrieval.admitted_vectors(lex, _examples(spark, sf_dir), _chunks(spark, sf_dir), "id", "embedding"), _ent(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of questions end to end: lanes, fused ranks, confidence, routing, top evidence."""
    fused = _fused(spark, sf_dir)
    routed = fused.where(F.col("place") <= DEFAULT.evidence).withColumn("confidence", gates.confidence("score"))
    return routed.select("query_id", "chunk_id", "place", "score", "confidence", gates.route("confidence").alias("routing"))


# --- lanes, ranks, fusion ------------------------------------------------------------------


@query(f"WITH {_LEX_SQL} SELECT query_id, chunk_id, round(lex, 6) AS lex FROM lex")
def lexical_hits(spark, sf_dir):
    return _lex(spark, sf_dir).select("query_id", "chunk_id", F.round("lex", 6).alias("lex"))


@query(f"WITH {_LEX_SQL} SELECT query_id, chunk_id, rank() OVER (PARTITION BY query_id ORDER BY round(lex, 9) DESC)::INT AS r FROM lex")
def lexical_rank(spark, sf_dir):
    return _lex(spark, sf_dir).select("query_id", "chunk_id", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("lex", 9)))).alias("r"))


@query(f"WITH {_VEC_SQL} SELECT query_id, chunk_id, round(vec, 6) AS vec FROM vec WHERE vec >= 0.65")
def vector_threshold(spark, sf_dir):
    return _vec(spark, sf_dir, floor=0.65).select("query_id", "chunk_id", F.round("vec", 6).alias("vec"))


@query(f"WITH {_VEC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vec, 9) DESC, chunk_id) AS place FROM vec) SELECT query_id, chunk_id, place::INT AS place FROM r WHERE place <= 10")
def vector_topk(spark, sf_dir):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("vec", 9)), "chunk_id")
    return _vec(spark, sf_dir, top=10).withColumn("place", F.row_number().over(w)).where("place <= 10").select("query_id", "chunk_id", "place")


_GRAMS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_EDGE_SQL = f"""t AS (SELECT id AS chunk_id, {_GRAMS.format('content')} AS t FROM document_chunks WHERE content IS NOT NULL),
g AS (SELECT chunk_id, unnest(list_concat(t, list_transform(generate_series(1, greatest(len(t) - 1, 0)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(generate_series(1, greatest(len(t) - 2, 0)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS alias FROM t),
a_ AS (SELECT DISTINCT array_to_string({_GRAMS.format('alias')}, ' ') AS alias, canonical FROM term_aliases),
e AS (SELECT DISTINCT chunk_id, canonical FROM g JOIN a_ USING (alias) WHERE alias <> '')"""


_HYBRID_SQL = f"""WITH {_LEX_SQL}, {_VEC_SQL}, {_EDGE_SQL},
qt AS (SELECT query_id, {_GRAMS.format('text')} AS t FROM q),
qg AS (SELECT query_id, unnest(list_concat(t, list_transform(generate_series(1, greatest(len(t) - 1, 0)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(generate_series(1, greatest(len(t) - 2, 0)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS alias FROM qt),
qe AS (SELECT DISTINCT query_id, canonical FROM qg JOIN a_ USING (alias) WHERE alias <> ''),
ent AS (SELECT query_id, chunk_id, count(*) AS ent FROM qe JOIN e USING (canonical) GROUP BY ALL),
j AS (SELECT query_id, chunk_id, round(coalesce(lex, 0), 9) AS lex, round(coalesce(vec, -1), 9) AS vec, coalesce(ent, 0) AS ent FROM lex FULL JOIN vec USING (query_id, chunk_id) LEFT JOIN ent USING (query_id, chunk_id)),
ad AS (SELECT * FROM j WHERE lex > 0 OR vec >= 0.65),
r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY lex DESC) AS rl, rank() OVER (PARTITION BY query_id ORDER BY vec DESC) AS rv, rank() OVER (PARTITION BY query_id ORDER BY ent DESC) AS re FROM ad),
s AS (SELECT *, round(0.3::DOUBLE / (60 + rl) + 0.7::DOUBLE / (60 + rv) + CASE WHEN ent > 0 THEN 0.15::DOUBLE / (60 + re) ELSE 0 END, 12) AS score FROM r),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s) WHERE place <= 100)"""


@query(f"{_HYBRID_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, place::INT AS place FROM fused")
def hybrid_candidates(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "place")


@query(f"{_HYBRID_SQL}, c AS (SELECT query_id, chunk_id, place::INT AS place, round_even(least(100, score / (1.0::DOUBLE / 61) * 100), 1) AS confidence FROM fused WHERE place <= 3) SELECT *, CASE WHEN confidence >= 90 THEN 'answer' WHEN confidence >= 50 THEN 'partial' ELSE 'no_answer' END AS routing FROM c")
def answer_routing(spark, sf_dir):
    return flagship(spark, sf_dir).select("query_id", "chunk_id", "place", "confidence", "routing")


_CAND_SQL = "c AS (SELECT DISTINCT query_id * 10 + sub_no AS query_id, chunk_id, bm25_score, vec_score FROM search_candidates)"


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "search_candidates").select((F.col("query_id") * 10 + F.col("sub_no")).alias("query_id"), "chunk_id", "bm25_score", "vec_score").distinct()


@query(f"""WITH {_CAND_SQL},
a AS (SELECT query_id, chunk_id, bm25_score AS s, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS r FROM c WHERE bm25_score IS NOT NULL),
b AS (SELECT query_id, chunk_id, vec_score AS s, row_number() OVER (PARTITION BY query_id ORDER BY vec_score DESC, chunk_id) AS r FROM c WHERE vec_score IS NOT NULL),
j AS (SELECT query_id, chunk_id, coalesce(a.r, 9999) AS ra, round(0.3::DOUBLE / (60 + coalesce(a.r, 9999)) + 0.7::DOUBLE / (60 + coalesce(b.r, 9999)), 12) AS rrf FROM a FULL JOIN b USING (query_id, chunk_id))
SELECT query_id, chunk_id, round(rrf, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, ra, chunk_id)::INT AS combined_rank FROM j""")
def rank_fusion_two_channel(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    lane = lambda name: c.where(F.col(name).isNotNull()).select("query_id", "chunk_id", F.col(name).alias("score"))
    return retrieval.rank_fusion(lane("bm25_score"), lane("vec_score")).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "combined_rank")


@query(f"WITH {_CAND_SQL} SELECT query_id, chunk_id, round(0.3::DOUBLE * coalesce(bm25_score, 0) + 0.7::DOUBLE * coalesce(vec_score, 0), 9) AS score FROM c")
def linear_fusion(spark, sf_dir):
    return retrieval.linear_fusion(_candidates(spark, sf_dir), "bm25_score", "vec_score").select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("WITH s AS (SELECT DISTINCT query_id, sub_no, chunk_id, rrf_score FROM search_candidates) SELECT s.query_id, s.sub_no, s.chunk_id, round(rrf_score * CASE WHEN regexp_matches(regexp_replace(content, '^\\s+', ''), '^([a-z]|\\(\\s*generated)') THEN 0.35::DOUBLE ELSE 1 END, 9) AS score FROM s JOIN document_chunks d ON d.id = s.chunk_id")
def fragment_penalty(spark, sf_dir):
    s = table(spark, sf_dir, "search_candidates").select("query_id", "sub_no", "chunk_id", "rrf_score").distinct()
    d = _chunks(spark, sf_dir).select(F.col("id").alias("chunk_id"), "content")
    return s.join(d, "chunk_id").select("query_id", "sub_no", "chunk_id", F.round(retrieval.with_fragment_penalty("rrf_score", "content"), 9).alias("score"))


@query("""WITH s AS (SELECT DISTINCT query_id * 10 + sub_no AS query_id, chunk_id, rrf_score, vec_score FROM search_candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, chunk_id) AS place FROM s),
h AS (SELECT *, place <= 5 AND vec_score IS NOT NULL AS head FROM r)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, CASE WHEN head THEN -vec_score END, place)::INT AS place FROM h""")
def rerank_head(spark, sf_dir):
    s = table(spark, sf_dir, "search_candidates").select((F.col("query_id") * 10 + F.col("sub_no")).alias("query_id"), "chunk_id", "rrf_score", "vec_score").distinct()
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), "chunk_id")))
    return retrieval.rerank(ranked.select("query_id", "chunk_id", "place"), s.select("query_id", "chunk_id", F.col("vec_score").alias("rerank_score"))).select("query_id", "chunk_id", "place")


def _edges(spark, sf_dir):
    return retrieval.entity_edges(_chunks(spark, sf_dir).where("content is not null"), "id", "content", table(spark, sf_dir, "term_aliases"))


@query(f"WITH {_EDGE_SQL} SELECT * FROM e")
def entity_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_EDGE_SQL} SELECT chunk_id, count(DISTINCT canonical) AS n FROM e GROUP BY chunk_id")
def entity_count(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("chunk_id").agg(F.countDistinct("canonical").alias("n"))


# --- filters -------------------------------------------------------------------------------

_LIVE = "SELECT c.id FROM document_chunks c JOIN documents d ON d.doc_id = c.document_id WHERE c.is_active AND c.is_approved AND c.embedding IS NOT NULL AND d.is_active AND d.is_approved"


@query(_LIVE)
def approved_only(spark, sf_dir):
    return scope.approved(_chunks(spark, sf_dir), table(spark, sf_dir, "documents")).select("id")


def _rbac(name: str, sql: str, **caller):
    @query(f"SELECT doc_id FROM documents WHERE {sql}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").where(scope.visible(**caller)).select("doc_id")

    _QUERIES[name], _ORACLES[name] = _QUERIES.pop("run"), _ORACLES.pop("run")


_rbac("rbac_admin", "true", role="admin")
_rbac("rbac_client", "client_id = 'CL-0017'", role="client", client_id="CL-0017")
_rbac("rbac_staff", "client_id IS NULL OR client_id IN ('CL-0001', 'CL-0002')", role="processor", assigned=["CL-0001", "CL-0002"])
_rbac("rbac_staff_unassigned", "client_id IS NULL", role="processor")
_rbac("rbac_none", "false", role=None)


@query("""WITH u AS (SELECT id AS user_id, client_id AS s FROM users WHERE role = 'client' UNION SELECT id, unnest(assigned_clients) FROM users WHERE role IN ('processor', 'underwriter', 'manager', 'compliance'))
SELECT u.user_id, d.doc_id FROM documents d JOIN u ON d.client_id = u.s""")
def rbac_batch(spark, sf_dir):
    users = table(spark, sf_dir, "users").select(F.col("id").alias("user_id"), "role", "client_id", "assigned_clients")
    return scope.visible_to_users(table(spark, sf_dir, "documents").select("doc_id", "client_id"), users).select("user_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE version >= 2 AND is_active AND is_approved")
def version_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(scope.version_filter(least_version=2)).select("doc_id")


@query("SELECT DISTINCT id FROM audit_log WHERE confidence >= 0.5 AND created_at >= TIMESTAMP '2024-01-01' AND outcome = 'answered'")
def audit_filter(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where(scope.audit_filter(since="2024-01-01", least_confidence=0.5, outcome="answered")).select("id").distinct()


@query("SELECT uploaded_by, count(*) AS n FROM documents WHERE uploaded_by IS NOT NULL GROUP BY 1")
def own_uploads(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("uploaded_by is not null").groupBy("uploaded_by").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM audit_log WHERE list_contains(retrieved_ids, 10) GROUP BY id")
def array_membership(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where(F.array_contains("retrieved_ids", 10)).select("id").distinct()




@query(f"SELECT DISTINCT id, CASE WHEN regexp_matches(query, '{L.PERSONAL_DATA}') THEN 'personal_data' WHEN regexp_matches(query, '{L.FRAUD_VERB}') AND regexp_matches(query, '{L.FRAUD_TARGET}') THEN 'fraud_intent' END AS reason FROM audit_log WHERE reason IS NOT NULL")
def scope_guard(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").select("id", T.out_of_scope("query").alias("reason")).where("reason is not null").distinct()


@query("SELECT client_id, count(*) AS n FROM documents WHERE length(client_id) <= 100 AND length(trim(client_id)) > 0 GROUP BY 1")
def valid_client_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(scope.valid_client_id("client_id")).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


# --- joins and aggregates ------------------------------------------------------------------


@query("SELECT a.id, a.query, u.email FROM (SELECT DISTINCT id, user_id, query, created_at FROM audit_log) a LEFT JOIN users u ON u.id = a.user_id ORDER BY a.created_at DESC, a.id DESC LIMIT 50 OFFSET 50")
def audit_page(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").select("id", "user_id", "query", "created_at").distinct()
    u = table(spark, sf_dir, "users").select(F.col("id").alias("user_id"), "email")
    page = a.orderBy(F.desc("created_at"), F.desc("id")).offset(50).limit(50)  # the feature: one page
    return page.join(u, "user_id", "left").select("id", "query", "email")


@query("SELECT f.id, u.email, f.rating FROM (SELECT DISTINCT id, user_id, rating FROM feedback) f LEFT JOIN users u ON u.id = f.user_id")
def feedback_with_users(spark, sf_dir):
    u = table(spark, sf_dir, "users").select(F.col("id").alias("user_id"), "email")
    return table(spark, sf_dir, "feedback").select("id", "user_id", "rating").distinct().join(u, "user_id", "left").select("id", "email", "rating")


@query("SELECT DISTINCT id, query, intent, confidence FROM knowledge_gaps WHERE confidence IS NULL OR confidence < 0.5")
def knowledge_gaps(spark, sf_dir):
    return ingest.gap_rows(table(spark, sf_dir, "knowledge_gaps"), 0.5).select("id", "query", "intent", "confidence").distinct()


@query("SELECT DISTINCT id, rating FROM feedback WHERE rating IN (-1, 1)")
def feedback_check(spark, sf_dir):
    return ingest.feedback_rows(table(spark, sf_dir, "feedback")).select("id", "rating").distinct()


@query("""WITH a AS (SELECT DISTINCT id, outcome, confidence, latency_ms FROM audit_log)
SELECT count(*) AS total, count(*) FILTER (outcome = 'answered') AS answered, count(*) FILTER (outcome = 'no_answer') AS unanswered, round_even(coalesce(avg(confidence), 0) * 100, 1) AS mean_confidence,
(SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM users WHERE is_active) AS users, (SELECT count(DISTINCT id) FROM knowledge_gaps WHERE NOT acknowledged) AS open_gaps FROM a""")
def admin_stats(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").select("id", "outcome", "confidence", "latency_ms").distinct()
    one = a.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "answered").alias("answered"), F.count_if(F.col("outcome") == "no_answer").alias("unanswered"), F.bround(F.coalesce(F.avg("confidence"), F.lit(0.0)) * 100, 1).alias("mean_confidence"))
    d = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"))
    u = table(spark, sf_dir, "users").where("is_active").agg(F.count(F.lit(1)).alias("users"))
    g = table(spark, sf_dir, "knowledge_gaps").where("not acknowledged").agg(F.countDistinct("id").alias("open_gaps"))
    return one.join(d, F.lit(True)).join(u, F.lit(True)).join(g, F.lit(True))  # rows of one


@query("SELECT outcome, count(*) AS n, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence IS NULL) AS unknown FROM (SELECT DISTINCT id, outcome, confidence FROM audit_log) GROUP BY 1")
def outcome_filter_counts(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").select("id", "outcome", "confidence").distinct()
    return a.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("high"), F.count_if(F.col("confidence").isNull()).alias("unknown"))


@query("SELECT outcome, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM (SELECT DISTINCT id, outcome, latency_ms FROM audit_log) GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    a = table(spark, sf_dir, "audit_log").select("id", "outcome", "latency_ms").distinct()
    found = ordered.percentiles(a, "outcome", "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("outcome", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT rating, f.id, a.id AS audit_id FROM (SELECT DISTINCT id, response_id, rating FROM feedback) f JOIN (SELECT DISTINCT id, response_id FROM audit_log) a USING (response_id)")
def feedback_of_answers(spark, sf_dir):
    f = table(spark, sf_dir, "feedback").select("id", "response_id", "rating").distinct()
    a = table(spark, sf_dir, "audit_log").select(F.col("id").alias("audit_id"), "response_id").distinct()
    return f.join(a, "response_id").select("rating", "id", "audit_id")


@query("SELECT DISTINCT c.document_id FROM (SELECT DISTINCT unnest(retrieved_ids) AS id FROM audit_log) r JOIN document_chunks c USING (id) WHERE c.document_id IS NOT NULL")
def documents_of_answers(spark, sf_dir):
    ids = table(spark, sf_dir, "audit_log").select(F.explode("retrieved_ids").alias("id")).distinct()
    return _chunks(spark, sf_dir).select("id", "document_id").join(ids, "id", "left_semi").select("document_id").where("document_id is not null").distinct()


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def best_by(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT l_orderkey, len(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY 1")
def array_agg_distinct_size(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.size(F.collect_set("l_suppkey")).cast("bigint").alias("suppliers"))


@query("SELECT coalesce(l_returnflag, 'all') AS category, count(*) AS n, round(avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END), 6) AS pass_rate FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def category_pass_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("l_quantity") > 25, 1).otherwise(0)), 6).alias("pass_rate")).select(F.coalesce("l_returnflag", F.lit("all")).alias("category"), "n", "pass_rate")


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events")
def login_window_count(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.col("ts").cast("timestamp").cast("double"))
    return ordered.window_count(e.select("user_id", "event_id", "s"), "user_id", "s", 900, "in_window").drop("s")


@query("SELECT date_trunc('day', created_at) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM audit_log GROUP BY 1")
def audit_by_day(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").groupBy(F.date_trunc("day", "created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


# --- rewrites ------------------------------------------------------------------------------


@query(f"SELECT h, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(lower({sql_strip('text')})) AS h FROM documents WHERE text IS NOT NULL) GROUP BY h")
def content_hash_dedup(spark, sf_dir):
    return store.first_by_hash(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.content_hash("text").alias("h")), "h", ["doc_id"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, (o_orderkey % 2) DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", F.col("o_orderkey") % 2, "o_orderkey").alias("at"))
    return store.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "at").drop("at")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_new_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.insert_new(o, table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)")
def in_subquery_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"))
    return store.delete_in(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT c.id, CASE WHEN c.is_active AND d.is_active AND d.department = 'underwriting' THEN true ELSE c.is_approved END AS is_approved FROM document_chunks c LEFT JOIN documents d ON d.doc_id = c.document_id")
def approve_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    _, chunks = store.approve(d, _chunks(spark, sf_dir), d.where("department = 'underwriting'").select("doc_id"))
    return chunks.select("id", "is_approved")


@query("SELECT id, CASE WHEN id = 5 THEN true ELSE acknowledged END AS acknowledged FROM (SELECT DISTINCT id, acknowledged FROM knowledge_gaps)")
def acknowledge_gap(spark, sf_dir):
    return store.update_where(table(spark, sf_dir, "knowledge_gaps").select("id", "acknowledged").distinct(), F.col("id") == 5, acknowledged=F.lit(True))


@query("SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'manager' END, role) AS role, coalesce(CASE WHEN id % 5 = 0 THEN 'Ops' END, department) AS department FROM users")
def partial_update(spark, sf_dir):
    u = table(spark, sf_dir, "users").select("id", "role", "department")
    return store.patch(u, u.select("id", F.when(F.col("id") % 3 == 0, "manager").alias("role"), F.when(F.col("id") % 5 == 0, "Ops").alias("department")), "id")


@query("SELECT id, len(list_distinct(list_concat(coalesce(assigned_clients, []), ['CL-0009']))) AS n FROM users")
def array_append(spark, sf_dir):
    return table(spark, sf_dir, "users").select("id", F.size(store.append_distinct("assigned_clients", F.lit("CL-0009"))).cast("bigint").alias("n"))


@query("SELECT l_linenumber, l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.delete_in(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey"), gone, "l_orderkey")


# --- text ----------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INT) AS tokens FROM documents WHERE text IS NOT NULL")
def doc_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.token_count("text").alias("tokens"))


@query("SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_split_to_array(content, '[^A-Za-z'']+')) AS w FROM document_chunks) WHERE length(w) >= 3 AND regexp_full_match(lower(w), '[a-z][a-z''-]*')")
def corpus_vocabulary(spark, sf_dir):
    w = _chunks(spark, sf_dir).select(F.explode(F.split("content", "[^A-Za-z']+")).alias("w")).select(F.lower("w").alias("word"))
    return w.where((F.length("word") >= 3) & F.col("word").rlike(r"^[a-z][a-z'-]*$")).distinct()


@query(f"SELECT id, len(list_filter(string_split(regexp_replace({sql_strip('content')}, '([.!?])[{WS}]+', '\\1␞', 'g'), '␞'), lambda s: s <> ''))::INT AS n FROM document_chunks WHERE content IS NOT NULL")
def sentence_split_counts(spark, sf_dir):
    return _chunks(spark, sf_dir).where("content is not null").select("id", F.size(T.sentences("content")).alias("n"))


@query(f"SELECT id, regexp_matches(content, '^[{WS}]*[\\p{{Lu}}\\p{{Nd}}\"''*•|-]') AS clean FROM document_chunks WHERE content IS NOT NULL")
def starts_cleanly(spark, sf_dir):
    return _chunks(spark, sf_dir).where("content is not null").select("id", T.starts_cleanly("content").alias("clean"))


@query("SELECT id, CASE WHEN length(content) <= 200 THEN content WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > 100 THEN left(h, length(h) - strpos(reverse(h), ' ')) || '…' ELSE h || '…' END AS excerpt FROM (SELECT id, content, left(content, 199) AS h FROM document_chunks WHERE content IS NOT NULL)")
def truncate_excerpt(spark, sf_dir):
    return _chunks(spark, sf_dir).where("content is not null").select("id", T.truncate("content", 200).alias("excerpt"))


@query("SELECT id FROM document_chunks WHERE len(list_filter(string_split(content, chr(10)), lambda s: starts_with(trim(s), '|'))) >= 2 OR contains(lower(content), '<table')")
def markdown_table_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).where(T.has_markdown_table("content")).select("id")


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(h, '{k}') THEN '{v}'" for k, v in L.DOC_TYPE_KEYWORDS) + " ELSE 'policy' END AS doc_type FROM (SELECT doc_id, left(lower(coalesce(text, '')), 2000) AS h FROM documents)")
def guess_doc_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_doc_type("text").alias("doc_type"))


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')[1:5] AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(list_filter(l, lambda s: len(list_filter(regexp_split_to_array(s, '[{WS}]+'), lambda w: w <> '')) <= 12 AND NOT (lower(s) = s AND upper(s) <> s))[1], left(l[1], 80)) AS title FROM l""")
def guess_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.guess_title("text").alias("title"))


_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{k}')" for k in ks) + f" THEN '{name}'" for name, ks in L.INTENTS.items()) + " ELSE 'general' END"


@query(f"SELECT DISTINCT id, {_INTENT} AS intent FROM (SELECT id, lower(query) AS s FROM knowledge_gaps WHERE query IS NOT NULL)")
def intent(spark, sf_dir):
    return table(spark, sf_dir, "knowledge_gaps").where("query is not null").select("id", T.intent("query").alias("intent")).distinct()


@query(f"SELECT DISTINCT id, trim(regexp_replace(regexp_replace(query, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}{WS}%$.\\-'']+', ' ', 'g'), '[{WS}]+', ' ', 'g')) AS clean FROM audit_log WHERE query IS NOT NULL")
def clean_search(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where("query is not null").select("id", T.clean_for_search("query").alias("clean")).distinct()


def _sql_stop() -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(L.QUESTION_STARTERS) | set(L.RELEVANCE_STOP)))


def _sql_skipped() -> str:
    return ", ".join(f"'{w}'" for w in sorted({*L.QUESTION_STARTERS, *L.RELEVANCE_STOP, *L.COMPLEX_MARKERS}))


@query(f"SELECT DISTINCT id, len(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z'']+'), lambda w: length(w) >= 3 AND NOT list_contains([{_sql_stop()}], w))))::INT AS n FROM audit_log WHERE query IS NOT NULL")
def content_term_counts(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where("query is not null").select("id", F.size(T.content_terms("query")).alias("n")).distinct()


@query("SELECT DISTINCT id, " + " OR ".join(f"contains(' ' || lower(trim(query)) || ' ', '{m}')" for m in L.COMPLEX_MARKERS) + f" OR length(query) - length(replace(query, '?', '')) > 1 OR contains(query, ';') OR len(list_filter(regexp_extract_all(' ' || lower(trim(query)) || ' ', '[a-z'']+'), lambda w: NOT list_contains([{_sql_skipped()}], w))) > 6 AS complex FROM audit_log WHERE query IS NOT NULL")
def complexity_router(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where("query is not null").select("id", T.is_complex("query").alias("complex")).distinct()


@query(None)
def normalized_queries(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").select("id", T.normalize("query").alias("normalized")).distinct()


@query(None)
def comparison_operands(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").select("id", T.comparison(F.lower("query")).alias("c")).where("c is not null").select("id", "c.left", "c.right").distinct()


@query("SELECT DISTINCT id, round(confidence * 100, 6) AS confidence, CASE WHEN confidence * 100 >= 90 THEN 'answer' WHEN confidence * 100 >= 50 THEN 'partial' ELSE 'no_answer' END AS routing FROM audit_log WHERE confidence IS NOT NULL")
def confidence_routing(spark, sf_dir):
    return table(spark, sf_dir, "audit_log").where("confidence is not null").withColumn("confidence", F.col("confidence") * 100).select("id", F.round("confidence", 6).alias("confidence"), gates.route("confidence").alias("routing")).distinct()


@query("SELECT event_id, round(value * CASE WHEN r >= 0.7 THEN 1 WHEN r >= 0.35 THEN 0.55 + (r - 0.35) / 0.35 * 0.45 ELSE 0.35 + r / 0.35 * 0.2 END, 6) AS confidence FROM (SELECT event_id, value, (event_id % 100)::DOUBLE / 100 AS r FROM events)")
def recalibrated_confidence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(gates.recalibrate("value", (F.col("event_id") % 100).cast("double") / 100), 6).alias("confidence"))


@query("SELECT event_id, CASE WHEN coalesce(s >= -6.5, true) THEN value ELSE least(value, 20) END AS confidence FROM (SELECT event_id, value, CASE WHEN event_id % 7 <> 0 THEN (event_id % 20)::DOUBLE - 12 END AS s FROM events)")
def answerability_cap(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 20).cast("double") - 12))
    return e.select("event_id", F.when(gates.answerable("s"), F.col("value")).otherwise(F.least("value", F.lit(20.0))).alias("confidence"))


# --- metrics -------------------------------------------------------------------------------

_RANK_SQL = """s AS (SELECT DISTINCT query_id * 10 + sub_no AS query_id, chunk_id, rrf_score, is_approved, combined_rank FROM search_candidates),
q AS (SELECT DISTINCT query_id FROM s),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC NULLS LAST, chunk_id) AS place FROM s),
g AS (SELECT DISTINCT query_id, chunk_id FROM s WHERE combined_rank <= 3)"""


def _ranking(spark, sf_dir):
    s = table(spark, sf_dir, "search_candidates").select((F.col("query_id") * 10 + F.col("sub_no")).alias("query_id"), "chunk_id", "rrf_score", "combined_rank").distinct()
    ranking = s.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rrf_score"), "chunk_id")).alias("place"))
    return s.select("query_id").distinct(), ranking, s.where("combined_rank <= 3").select("query_id", "chunk_id").distinct()


@query(f"""WITH {_RANK_SQL}, ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT r.query_id, k, count(*) AS h, min(place) AS f, sum(1 / log2(place + 1)) AS dcg FROM r JOIN g USING (query_id, chunk_id), ks WHERE place <= k GROUP BY 1, 2),
b AS (SELECT q.query_id, ks.k, coalesce(n, 0) AS n, coalesce(h, 0) AS h, f, dcg FROM q CROSS JOIN ks LEFT JOIN n USING (query_id) LEFT JOIN h ON h.query_id = q.query_id AND h.k = ks.k)
SELECT k, round(avg(CASE WHEN n = 0 OR h > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(coalesce(1.0 / f, 0)), 6) AS rr, round(avg(h::DOUBLE / k), 6) AS precision, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE h::DOUBLE / n END), 6) AS recall,
round(avg(CASE WHEN n > 0 THEN least(1.0, coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, k)), lambda i: 1 / log2(i + 1)))) END), 6) AS ndcg FROM b GROUP BY k""")
def retrieval_metrics(spark, sf_dir):
    return metrics.summary(*_ranking(spark, sf_dir), [1, 3, 5, 10])


@query(f"""WITH {_RANK_SQL}, m AS (SELECT r.query_id, place, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM r LEFT JOIN g USING (query_id, chunk_id)),
c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY place) AS run FROM m) SELECT query_id, round(sum(CASE WHEN rel = 1 THEN run / place ELSE 0.0 END) / count(*), 6) AS mean_precision FROM c GROUP BY 1""")
def mean_precision(spark, sf_dir):
    _, ranking, relevant = _ranking(spark, sf_dir)
    return metrics.average_precision(ranking, relevant)


from . import answer_catalog, fixture_catalog, ingest_catalog  # noqa: E402,F401  they register their queries
