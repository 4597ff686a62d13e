"""Text functions, chunking, extraction and the limiter on small fixtures."""

import io
import zipfile

import pytest

from skein.functions import dialogue, phrases
from skein.functions import text as T
from skein.sources import chunking, extract, harvest
from skein.streaming.limiter import Limiter


def one(spark, column, *values):
    rows = [(v,) for v in values]
    return [r[0] for r in spark.createDataFrame(rows, "x string").select(column("x")).collect()]


def test_normalize(spark):
    assert one(spark, T.normalize, "What’s  the the LTV??", "don't PANIC ,ok", None) == ["what is the ltv?", "do not panic, ok", ""]


def test_stems_and_relevance(spark):
    assert set(one(spark, T.stems, "payments")[0]) >= {"payments", "payment"}
    df = spark.createDataFrame([("what payments apply", "a payment is due"), ("what is it", "x"), ("rent ledger", "")], "q string, t string")
    assert [round(r[0], 3) for r in df.select(T.relevance("q", "t")).collect()] == [0.5, 1.0, 0.0]


def test_intent_scope_comparison(spark):
    assert one(spark, T.intent, "max amount", "how to apply", "hello") == ["limits", "process", "general"]
    assert one(spark, T.out_of_scope, "what is my credit score", "how do I fake a pay stub", "what is a payslip") == ["personal_data", "fraud_intent", None]
    assert [tuple(x) if x else None for x in one(spark, T.comparison, "compare rate lock with gift letter?", "payslip vs ledger", "what is a payslip")] == [("rate lock", "gift letter"), ("payslip", "ledger"), None]


def test_truncate(spark):
    assert one(spark, lambda c: T.truncate(c, 10), "short", "alpha beta gamma") == ["short", "alpha bet…"]


def test_grounded(spark):
    df = spark.createDataFrame([("The fee is 3.5%.", "A fee of 3.5% applies"), ("The fee is 4%.", "A fee of 3.5% applies")], "a string, e string")
    assert [r[0] for r in df.select(T.grounded("a", "e")).collect()] == [True, False]


def test_markdown_table(spark):
    df = spark.createDataFrame([([["a", "b"], ["1"]],)], "r array<array<string>>")
    assert df.select(T.render_markdown_table("r")).first()[0] == extract.markdown_table([["a", "b"], ["1"]]) == "| a | b |\n| --- | --- |\n| 1 |  |"


def test_indel_ratio():
    assert [round(T.indel_ratio(a, b), 1) for a, b in (("respa", "repay"), ("inocme", "income"), ("finance", "refinance"))] == [80.0, 83.3, 87.5]


def test_split_questions():
    assert dialogue.split_questions("what is a payslip? how long is it valid") == (["what is a payslip", "how long is it valid"], False)
    assert dialogue.split_questions("what about income and employment") == (["what about income and employment"], False)
    assert dialogue.split_questions("max rate, required documents") == (["max rate", "required documents"], False)
    assert dialogue.split_questions("") == ([], False)


def test_speller_and_follow_ups():
    s = dialogue.Speller(["credit", "score", "escrow", "investment", "what"], ["credit score"])
    assert s.correct("credt scor") == "credit score"
    assert s.correct("investmnt of 5%") == "investment of 5%"
    assert dialogue.variants("what is equity?", {"equity": ("home equity", "term")}) == ["what is equity?", "what is equity? home equity", "equity definition"]


def test_window():
    assert phrases.best_window("aa bb cc dd ee", [["cc"], ["dd"]], 5) == "…cc dd…"
    assert phrases.best_window("aa bb", [["cc"]], 5) == "aa bb" and phrases.best_window("aa bb cc", [["zz"]], 5) == "aa b…"


def test_chunking():
    text = "Core Terms\n\nLoan Limit: the most that may be lent.\n\n" + "Needs:\n- payslip\n- ledger\n\n" + "One sentence here. " * 200
    kinds = [(c.chunk_type, c.section) for c in chunking.chunk_document(text)]
    assert kinds[0] == ("definition", "Core Terms") and kinds[1] == ("checklist", "Core Terms")
    assert all(chunking.tokens(c.content) <= 300 for c in chunking.chunk_document(text))
    assert chunking.chunk_document("") == chunking.chunk_document(None) == []


def test_recursive_chunks_keep_all_words():
    text = "Alpha beta, gamma; delta. " * 300
    assert " ".join(chunking.recursive_chunks(text, 50)).split() == text.split()


def test_acronyms():
    assert harvest.acronyms("The Loan to Value (LTV) matters. DTI: Debt to Income.") == [("ltv", "loan to value"), ("dti", "debt to income")]
    assert harvest.acronyms("Nothing (XYZ) fits") == []


def test_extract_formats(tmp_path, spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(docx.getvalue())
    (tmp_path / "b.html").write_text("<p>One</p><b>two</b>")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["source_format"]: (r["text"], r["error"]) for r in extract.read_files(spark, str(tmp_path)).collect()}
    assert got["docx"][0] == "Hello" and got["html"][0] == "One\ntwo" and got["csv"][0].startswith("| x | y |")
    assert got["pdf"][1].startswith("ValueError")


def test_limiter():
    state = Limiter()
    assert all(state.request(i * 0.1) for i in range(120)) and not state.request(12.0) and state.request(61.0)
    locked = Limiter()
    for i in range(20):
        locked.request(float(i * 10), failure=True)
    assert not locked.request(500.0) and locked.request(190.0 + 901)


def test_directory_stream(tmp_path, spark):
    from skein.streaming.ingest import watch_directory

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    seen = []
    q = watch_directory(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r["path"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert len(seen) == 1


def test_pushdown(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/documents.parquet").where("is_active and version >= 2").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(is_active)" in plan and "text" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("role,expected", [("admin", 3), ("client", 1), ("processor", 2), (None, 0), ("other", 0)])
def test_scope(spark, role, expected):
    from skein.operators.scope import visible

    df = spark.createDataFrame([("a",), ("b",), (None,)], "client_id string")
    assert df.where(visible(role, "a", ["b"])).count() == expected


def test_store(spark):
    from skein.operators import store

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted(r["v"] for r in store.upsert(old, new, ["k"], "t").collect()) == ["a", "c", "d"]
    assert [r["k"] for r in store.insert_new(old, new, ["k"], ["t"]).collect()] == [3]


def test_login_outcomes(spark, tmp_path):
    from skein.streaming.limiter import login_outcomes

    rows = [(i, float(i), "1.1.1.1", "a@x", False) for i in range(21)] + [(30, 30.0, "2.2.2.2", "a@x", True), (31, 31.0, "1.1.1.1", "b@x", True), (32, 32.0, "2.2.2.2", "b@x", True), (40, 1000.0, "2.2.2.2", "a@x", True)]
    df = spark.createDataFrame([("t", *r) for r in rows], "tenant string, attempt_id bigint, at double, address string, account string, ok boolean")
    told = {r["attempt_id"]: r["outcome"] for r in login_outcomes(df, "tenant").collect()}
    assert [told[i] for i in (0, 19, 20, 30, 31, 32, 40)] == ["failed", "failed", "locked", "locked", "locked", "in", "in"]
    df.where("attempt_id < 15").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    df.where("attempt_id >= 15").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    seen = {}
    q = login_outcomes(stream, "tenant").writeStream.foreachBatch(lambda b, _: seen.update({r["attempt_id"]: r["outcome"] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == told


def test_ingest(spark, tmp_path):
    from dataclasses import replace

    from skein.config import DEFAULT
    from skein.operators import ingest

    guide = "Rate Lock Guide\n\nThe Rate Lock Agreement (RLA) of Velder Bank fixes the rate for a time that both sides agree on in writing before the offer is made. " + "It is kept with the file. " * 12
    files = spark.createDataFrame(
        [("in/b.txt", "txt", guide, ["x"][:0], None, '{"doc_type": "procedure", "uploaded_by": "7", "department": 3}'), ("in/a.txt", "txt", guide, [], None, "{broken"), ("in/c.pdf", "pdf", "", [], "ValueError: no", None), ("in/d.txt", "txt", " ", [], None, None)],
        "path string, source_format string, text string, pages array<string>, error string, sidecar string",
    )
    terms = spark.createDataFrame([("velder bank", "velder", "lender"), ("rate", "interest rate", "metric")], "alias string, canonical string, type string")
    found = ingest.ingest(files, terms, first_id=10, config=replace(DEFAULT, embed=lambda texts: [[float(len(t))] for t in texts]))
    docs = {r["source_path"]: r for r in found.documents.collect()}
    assert sorted((r["doc_id"], r["doc_type"], r["department"], r["uploaded_by"], r["is_approved"]) for r in docs.values()) == [(10, "policy", "general", None, False), (11, "procedure", "general", 7, False)]
    chunks = found.chunks.collect()
    assert {r["doc_id"] for r in chunks} == {10} and all(len(r["embedding"]) == 1 for r in chunks)
    assert {(r["entity"], r["entity_type"]) for r in found.edges.collect()} == {("velder", "lender")}
    assert [(r["alias"], r["canonical"], r["document_id"]) for r in found.aliases.collect()] == [("rla", "rate lock agreement", 10)]
    table = str(tmp_path / "aliases")
    assert ingest.sink(found.aliases, table, ["alias"]).count() == 1 and ingest.sink(found.aliases, table, ["alias"]).count() in (0, 1)
    assert spark.read.parquet(table).count() == 1


def test_rerank_model(spark):
    from dataclasses import replace

    from skein.config import DEFAULT
    from skein.operators import retrieval

    pool = spark.createDataFrame([(1, 10, 1, "fee", "no"), (1, 11, 2, "fee", "the fee"), (1, 12, 3, "fee", "fee fee")], "query_id bigint, chunk_id bigint, place int, question string, content string")
    model = replace(DEFAULT, rerank=lambda asked, contents: [float(c.count(q)) for q, c in zip(asked, contents)], rerank_head=2)
    order = [r["chunk_id"] for r in retrieval.rerank(pool.select("query_id", "chunk_id", "place"), retrieval.rerank_scores(pool, model), model).orderBy("place").collect()]
    assert order == [11, 10, 12]
    assert retrieval.rerank_scores(pool).count() == 0


def test_ordered_operators(spark):
    import random

    from skein.operators import ordered

    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("ab"), float(rng.randrange(4000)), rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, s double, v double").repartition(5)
    before, counts = {}, {}
    for k in {r[1] for r in rows}:
        own = sorted((r[2], r[0]) for r in rows if r[1] == k)
        before.update({i: own[n - 1][1] if n else None for n, (_, i) in enumerate(own)})
        counts.update({i: sum(s - 900 <= t <= s for t, _ in own) for s, i in own})
    assert {r["id"]: r["previous"] for r in ordered.previous(df.withColumn("me", df["id"]), "k", ["s", "id"], "me").collect()} == before
    assert {r["id"]: r["n"] for r in ordered.window_count(df, "k", "s", 900, "n").collect()} == counts
    import numpy as np

    for r in ordered.percentiles(df, "k", "v", {"p50": 0.5, "p99": 0.99}).collect():
        own = [x[3] for x in rows if x[1] == r["k"]]
        assert abs(r["p50"] - np.percentile(own, 50)) < 1e-9 and abs(r["p99"] - np.percentile(own, 99)) < 1e-9


def test_vector_lane_blocks(spark):
    from skein.operators import retrieval

    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 1.0])], "id bigint, e array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0])], "query_id bigint, embedding array<float>")
    got = {(r["query_id"], r["chunk_id"]): round(r["vec"], 3) for r in retrieval.vector_hits(asked, chunks, "id", "e").collect()}
    assert got == {(7, 1): 1.0, (7, 2): 1.0, (7, 6): 0.707, (8, 1): 0.0, (8, 2): 1.0, (8, 6): 0.707}
    lex = spark.createDataFrame([(8, 1), (8, 3), (9, 1)], "query_id bigint, chunk_id bigint")
    assert {(r["query_id"], r["chunk_id"]): r["vec"] for r in retrieval.vector_scores(lex, asked, chunks, "id", "e").collect()} == {(8, 1): 0.0}
    assert retrieval.vector_hits(asked.limit(0), chunks, "id", "e").count() == 0
