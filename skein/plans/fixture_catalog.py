"""Catalogue entries on inline rows: text operators whose cases no table holds.

Each entry applies an operator to a few rows and gives them back with the result; the SQL states the
expected values, which follow from the operators' definitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import concepts as C
from ..functions import dialogue, phrases, plan
from ..functions import text as T
from ..operators import answers, gates, ingest, metrics, scope, store
from ..sources import chunking, harvest, metadata, ocr
from .catalog import _ORACLES, _QUERIES

TERMS = C.Dictionary({
    "velder bank": ("lender", ["velder", "vb"]), "harrow mutual": ("lender", ["harrow"]), "home equity": ("product", ["equity", "he loan"]), "loan to value": ("metric", ["ltv"]), "credit score": ("metric", ["score", "credit scores"]),
})
SPELLER = dialogue.Speller("what credit score escrow payment income document mortgage review maximum minimum".split(), ["credit score", "escrow account"], frozenset(["lending"]))
SCENARIOS = [(r"\bretir(?:e|ed|ing)\b|\bpension", "later life loan"), (r"\bbridge loan\b|\bbuying before selling\b", "bridging finance")]


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def fixture(name: str, schema: str, rows: list[tuple], apply, expected: list, kind: str = "VARCHAR"):
    """Registers ``name``: rows numbered from 1, ``apply(df)`` a Column of them, and what it must be."""

    def run(spark, sf_dir):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], f"n int, {schema}")
        return df.select("n", apply(df).alias("result"))

    _QUERIES[name] = run
    _ORACLES[name] = "SELECT n::INT AS n, result::" + kind + " AS result FROM (VALUES " + ", ".join(f"({i}, {_sql(e)})" for i, e in enumerate(expected, 1)) + ") v(n, result)"


def texts(name: str, function, values: list, expected: list, returns: str | None = "string", kind: str = "VARCHAR"):
    """Rows of one text; a plain function runs as an Arrow UDF, with ``returns`` None it makes a Column."""
    made = (lambda df: function(F.col("x"))) if returns is None else (lambda df: C.arrow(function, returns)(F.col("x")))
    fixture(name, "x string", [(v,) for v in values], made, expected, kind)


def pairs(name: str, function, rows: list[tuple], expected: list, returns: str, kind: str = "VARCHAR"):
    fixture(name, "a string, b string", rows, lambda df: C.arrow(function, returns)("a", "b"), expected, kind)


joined = lambda xs: "|".join(xs)

# --- questions -----------------------------------------------------------------------------

texts("fx_normalize", T.normalize, ["What’s  the the LTV??", "don't PANIC ,ok", "Café – now", None, "wont it,work...", "its a rule"], ["what is the ltv?", "do not panic, ok", "café - now", "", "will not it, work.", "it is a rule"], None)
texts("fx_split_questions", lambda t: joined(dialogue.split_questions(t)[0]), ["what is a payslip? how long is it valid", "what about income and employment", "max rate, required documents and the limits", "please; tell me the fee and also show the form", "", "loans of 1,000 or more and how to apply"], ["what is a payslip|how long is it valid", "what about income and employment", "max rate|required documents|the limits", "tell me the fee|show the form", "", "loans of 1,000 or more|how to apply"])
texts("fx_split_truncated", lambda t: dialogue.split_questions(t, most=2)[1], ["what is a? what is b? what is c", "what is a? what is b"], [True, False], "boolean", "BOOLEAN")
texts("fx_split_concepts", lambda t: joined(dialogue.split_questions(t, frozenset(TERMS.index))[0]), ["velder fees, harrow fees and the home equity", "amount and income"], ["velder fees|harrow fees|the home equity", "amount and income"])
texts("fx_self_contained", dialogue.self_contained, ["max dti", "required documents", "income", "", "the rate of it"], [True, True, False, False, True], "boolean", "BOOLEAN")
texts("fx_spelling", SPELLER.correct, ["credt scor of mortage", "investmnt of 5%", "escrow acount", "creditscore", "lending a paymnt", "whats"], ["credit score of mortgage", "investmnt of 5%", "escrow account", "credit score", "lending a payment", "whats"])
texts("fx_entities", lambda t: joined(f"{c}:{k}:{a}-{b}" for c, k, _, a, b in dialogue.entities(t, TERMS.index)), ["ltv at velder bank of 80%", "he loan for $1,500.50", "nothing"], ["loan to value:metric:0-3|velder bank:lender:7-18|percentage:percentage:22-25", "home equity:product:0-7|amount:amount:12-21", ""])
texts("fx_unique_canonicals", lambda t: joined(dialogue.unique_canonicals(dialogue.entities(t, TERMS.index))), ["ltv and score at 5% and ltv", "none"], ["loan to value|credit score", ""])
texts("fx_expand", lambda t: dialogue.expand(t, dialogue.entities(t, TERMS.index)), ["max ltv", "credit score at vb"], ["max ltv loan to value", "credit score at vb velder bank"])
texts("fx_variants", lambda t: joined(dialogue.variants(t, TERMS.index)), ["what is equity?", "max fee", ""], ["what is equity?|what is equity? home equity|equity definition", "max fee", ""])
texts("fx_scenarios", lambda t: joined(C.scenario_concepts(t, SCENARIOS)), ["I am retiring with a pension", "need a bridge loan when buying before selling", "plain"], ["later life loan", "bridging finance", ""])
texts("fx_intent", T.intent, ["max amount", "how to apply", "what is it", "fees of a form", "hello"], ["limits", "process", "definition", "costs", "general"], None)
texts("fx_comparison", lambda c: F.concat_ws("|", T.comparison(c)["left"], T.comparison(c)["right"]), ["compare rate lock with gift letter?", "payslip vs ledger", "difference between a and b", "how is x different from y", "what is a payslip", "a vs a"], ["rate lock|gift letter", "payslip|ledger", "a|b", "x|y", "", ""], None)
pairs("fx_shared_qualifier", lambda a, b: joined(C.shared_qualifier(a, b, TERMS, "lender")), [("velder", "harrow down payment"), ("velder minimum score", "harrow"), ("velder", "rate of harrow"), ("payslip", "harrow fee")], ["velder down payment|harrow down payment", "velder minimum score|harrow minimum score", "velder|rate of harrow", "payslip|harrow fee"], "string")
fixture("fx_follow_up", "q string, s string, own boolean", [("How is it repaid?", "lifetime loan", False), ("What of the same", "fee", False), ("what are the risks?", "bridge loan", False), ("what are the fees for France", "bridge loan", False), ("what are the fees", "bridge loan", True), ("is the fee $5", "fee", False), ("Can they go?", "a $1 \\ b", False), ("x", None, False)], lambda df: dialogue.follow_up("q", "s", "own"), ["How is lifetime loan repaid?", "What of fee", "bridge loan what are the risks?", "what are the fees for France", "what are the fees", "is the fee $5", "Can a $1 \\ b go?", "x"])
texts("fx_subject", lambda t: dialogue.subject_of(t, TERMS.index), ["what is the ltv at velder", "how long does the annual survey of land take now", "what is it", ""], ["loan to value", "long annual survey land", None, None])
texts("fx_canonical", lambda t: f"{TERMS.canonical_of(t)}:{TERMS.type_of(t)}", ["ltv", "harrow", "zzz"], ["loan to value:metric", "harrow mutual:lender", "zzz:None"])
texts("fx_names_concept", TERMS.names_concept, ["The LTV of it", "a he loan", "valtv", ""], [True, True, False, False], "boolean", "BOOLEAN")
texts("fx_synonyms", lambda t: joined(sorted(C.synonyms_of(t))), ["verify", "employed", "zzz"], ["verification|verified|verifying", "employed|employer|employers|employment|job", ""])
texts("fx_stems", lambda c: F.array_join(F.array_sort(T.stems(c)), "|"), ["payments", "policies", "fee", "verification", "lending"], ["payment|payments", "polici|policie|policies|policy", "fee", "verifica|verificae|verification", "lend|lende|lending"], None)
texts("fx_vocabulary", lambda t: joined(sorted(C.vocabulary_of(t.split()))), ["Payments of a co-op", "x1 fees"], ["co-op|payment|payments", "fee|fees"])
texts("fx_known_concept", lambda t: C.known_concept(t, {"amortization", "point"}), ["define amortization", "Points", "explain equity", ""], [True, True, False, False], "boolean", "BOOLEAN")
texts("fx_term_groups", lambda t: "; ".join(map(joined, C.term_groups(t, TERMS))), ["what is the max ltv of vb", "is it on"], ["ltv|loan|value; vb|bank|velder", ""])
texts("fx_supported_groups", lambda t: "; ".join(map(joined, C.supported(C.term_groups(t), frozenset(["payment", "loan"])))), ["payments that never change on loans", "zebra yak"], ["payments; loans", "zebra; yak"])
pairs("fx_relevance", lambda q, t: round(C.relevance(q, t, TERMS), 4), [("what payments apply", "a payment is due"), ("what is it", "x"), ("max ltv", "the loan may be"), ("verify a job", "employment verification"), ("rent ledger", "")], [0.5, 1.0, 1.0, 1.0, 0.0], "double", "DOUBLE")
texts("fx_without_subject", C.without_subject, ["what happens next?", "what is a payslip", "explain more", "how"], [True, False, True, False], "boolean", "BOOLEAN")
fixture("fx_alias_resolution", "t string, c array<string>", [("max ltv", ["loan-to-value", "loan to value", "ltv"]), ("loan to value rule", ["Loan-to-Value"]), ("x", [])], lambda df: C.arrow(lambda t, c: joined(C.missing_canonicals(t, c)), "string")("t", "c"), ["loan to value", "", ""])
texts("fx_topics", lambda t: joined(TERMS.topics(t, {"bridge": "bridging"})), ["ltv and a Bridge", "none here"], ["bridging|loan to value", ""])
texts("fx_suggestions", lambda t: joined(C.follow_up_suggestions(TERMS.topics(t), {"credit score": ["q1", "q2", "q3"], "loan to value": ["q4"]}, ["g1"])), ["ltv", "score and ltv", "none"], ["q4", "q1|q2|q3", "g1"])
texts("fx_prefix_query", lambda c: F.array_join(F.transform(T.prefixes(c), lambda w: F.concat(w, F.lit(":*"))), " | "), ["Rate Lock, now", "", "§§"], ["rate:* | lock:* | now:*", "", ""], None)
texts("fx_question_plan", lambda t: "; ".join(f"{p.text}>{p.expanded}>{joined(p.entities)}>{p.intent}" for p in plan.plan(t, None, TERMS, SPELLER, SCENARIOS)[0]), ["max ltv? what if i am retiring", "", "credt scor"], ["max ltv>max ltv loan to value>loan to value>limits; what if i am retiring>what if i am retiring later life loan>>general", "", "credit score>credit score>credit score>general"])
pairs("fx_similarity", lambda a, b: round(T.indel_ratio(a, b), 1), [("respa", "repay"), ("inocme", "income"), ("finance", "refinance"), ("", "")], [80.0, 83.3, 87.5, 100.0], "double", "DOUBLE")

# --- answers -------------------------------------------------------------------------------

texts("fx_is_question", T.is_question, ["What is it", "It is.", "Is it?", "Can do!", ""], [True, False, True, False, False], None, "BOOLEAN")
texts("fx_wrapped", answers.body, ["Head Line\nThe rate is\nfixed now.", "one\ntwo", "A.\nB."], ["The rate is fixed now.", "one two", "A.\nB."], None)
texts("fx_query_pairs", lambda t: joined(phrases.pairs_of(t)), ["max ltv for a second home loan", "what is it"], ["second home|home loan", ""])
pairs("fx_pair_hits", lambda p, t: phrases.pair_hits(t, p.split("|")), [("hvac filters", "HVAC filter replacement"), ("second home|home loan", "a second mortgage, home"), ("second home", "Second  homes")], [1, 0, 1], "int", "INT")
pairs("fx_best_window", lambda q, t: phrases.best_window(t, C.term_groups(q), 40), [("bankruptcy discharge years", "Waiting periods apply before a borrower is eligible; two years after a bankruptcy discharge is usual for some"), ("zebra", "short"), ("zebra", "a long text that says nothing of it at all, so its head is taken")], ["…two years after a bankruptcy discharge…", "short", "a long text that says nothing of it at…"], "string")
pairs("fx_table_row", lambda q, t: phrases.table_row(t, C.term_groups(q), 200), [("limit for garages", "| Type | Limit |\n|---|---|\n| House | 80% |\n| Garage | 60% |"), ("zebra", "| A |\n| b |")], ["| Garage | 60% |", "| A |\n| b |"], "string")
pairs("fx_sentence", lambda q, t: phrases.sentence(t, C.term_groups(q), 200), [("when must i occupy", "Loans are for primary homes only. The borrower must occupy the home within 60 days."), ("x", "Is it so? Note: none.\nHeading Only"), ("fee", "Yes it is.")], ["The borrower must occupy the home within 60 days.", "", "Yes it is."], "string")
fixture("fx_answer", "q string, e array<struct<text:string,kind:string,confidence:double>>", [("what is the fee of a survey", [("ents. The fee of a survey is 9.", "paragraph", 99.0), ("The fee of a survey depends on:", "paragraph", 95.0), ("The fee of a survey is set by the surveyor each year.", "paragraph", 90.0)]), ("minimum of 580", [("General words about a minimum that we use here.", "paragraph", 90.0), ("| A | B |\n|---|---|\n| minimum | 580 |", "table", 80.0)]), ("x", [])], lambda df: C.arrow(lambda q, e: joined(map(str, phrases.answer(q, [(x["text"], x["kind"], x["confidence"]) for x in e]))), "string")("q", "e"), ["The fee of a survey is set by the surveyor each year.|2", "| minimum | 580 ||1", "|-1"])
fixture("fx_response_id", "q string, c double", [("what", 90.5)], lambda df: C.arrow(lambda q, c: phrases.response_id(q, c, "seed"), "string")("q", "c"), [phrases.response_id("what", 90.5, "seed")])
_ORACLES["fx_response_id"] = "SELECT 1::INT AS n, left(sha256('what:90.5:seed'), 16) AS result"
fixture("fx_dampened", "c double, g boolean, t boolean, w boolean", [(90.0, True, True, True), (90.0, False, False, False), (90.0, False, True, False), (90.0, False, False, None), (60.0, True, False, True)], lambda df: gates.dampened("c", "g", "t", "w"), [74.0, 74.0, 90.0, 90.0, 60.0], "DOUBLE")
fixture("fx_scope_cap", "c double, x string", [(90.0, "what is my credit score"), (90.0, "how do I fake a pay stub"), (90.0, "what is a payslip")], lambda df: F.when(T.out_of_scope("x").isNotNull(), F.least("c", F.lit(15.0))).otherwise(F.col("c")), [15.0, 15.0, 90.0], "DOUBLE")
fixture("fx_routing", "q string, phrase string, relevance double, confidence double, score double", [("fee of it", "The fee", 1.0, 95.0, None), ("fee of it", "", 1.0, 95.0, None), ("fee of it", "x", 0.2, 95.0, None), ("fee of it", "x", 1.0, 95.0, -9.0), ("fee of it", "x", 0.5, 95.0, 1.0), ("what is my credit score", "x", 1.0, 95.0, 1.0)], lambda df: gates.gated("q", "phrase", "relevance", "confidence", "score")[1], ["answer", "no_answer", "no_answer", "no_answer", "partial", "no_answer"])
fixture("fx_package_error", "role string, client string, assigned array<string>, e array<struct<client_id:string,is_approved:boolean,version:int>>", [("client", "a", None, [("a", True, 1)]), ("client", "a", None, [("b", True, 1)]), ("processor", None, ["b"], [(None, True, 1), ("b", True, 2)]), ("processor", None, None, [("b", True, 1)]), ("admin", None, None, [("z", False, 1)]), ("admin", None, None, [("z", True, 0)]), (None, None, None, [])], lambda df: gates.package_error(F.col("role"), F.col("client"), F.col("assigned"), F.col("e")), [None, "not the reader's client", None, "client not assigned", "not approved", "invalid version", None])
fixture("fx_grounded", "a string, e string", [("The fee is 3.5%.", "A fee of 3.5% applies"), ("The fee is 4%.", "A fee of 3.5% applies"), ("Zebras run far.", "A fee")], lambda df: T.grounded("a", "e"), [True, False, False], "BOOLEAN")
texts("fx_complex", T.is_complex, ["compare a and b", "what is a fee", "fee? rate?", "lenders borrowers brokers underwriters appraisers notaries surveyors", "a; b"], [True, False, True, True, True], None, "BOOLEAN")
texts("fx_scope_guard", T.out_of_scope, ["what is my credit score", "how do I fake a pay stub", "status of my case", "what is a payslip", None], ["personal_data", "fraud_intent", "personal_data", None, None], None)
fixture("fx_primary_block", "b array<struct<routing:string,confidence:double,name:string>>", [([("no_answer", 99.0, "x"), ("partial", 60.0, "y"), ("answer", 95.0, "z")],), ([("no_answer", 20.0, "x"), ("no_answer", 30.0, "y")],), ([],)], lambda df: answers.primary("b")["name"], ["z", "y", None])
fixture("fx_retry", "a struct<score:double,name:string>, b struct<score:double,name:string>", [((-9.0, "a"), (2.0, "b")), ((-9.0, "a"), (-8.0, "b")), ((1.0, "a"), (5.0, "b")), ((None, "a"), (5.0, "b"))], lambda df: answers.retried("a", "b")["name"], ["b", "a", "a", "a"])

# --- ingestion -----------------------------------------------------------------------------

texts("fx_repair_bullets", T.repair_bullets, ["e Product\n• two\n· three\no four\n© five\ne.g. six\ne"], ["- Product\n- two\n- three\n- four\n- five\ne.g. six\ne"], None)
texts("fx_noise_line", T.is_noise_line, ["L", "|_", "LJ|", "ab", ""], [True, True, False, False, False], None, "BOOLEAN")
texts("fx_doubled", T.collapse_doubled, ["Rate SecuredRate Secured", "1010", "abcdefgh"], ["Rate Secured", "1010", "abcdefgh"], None)
texts("fx_ocr_text", ocr.clean_text, ["Steps:\n\ne one\n\ne two\n\nProse here.\nLJ", "a\n\nb", ""], ["Steps:\n- one\n- two\n\nProse here.", "a\n\nb", ""], None)
fixture("fx_ocr_pages", "p array<string>", [(["e one", "|_\n \n", "x"],), ([],)], lambda df: F.array_join(ocr.clean_pages("p"), "#"), ["- one#x", ""])
fixture("fx_needs_ocr", "s string, t string", [(".PDF", " x "), (".pdf", "y" * 51), (".txt", ""), (".pdf", None)], lambda df: ocr.needs_ocr("s", "t"), [True, False, False, True], "BOOLEAN")
texts("fx_heading", T.is_heading_line, ["RATE LOCK", "Section 4", "§ 2", "Steps —", "Note:", "plain words", "WHO:"], [True, True, True, True, False, False, False], None, "BOOLEAN")
texts("fx_title_like", chunking.title_like, ["Rate Lock of the Land", "Rate lock", "4 Steps"], [True, False, True], "boolean", "BOOLEAN")
texts("fx_chunks", lambda t: joined(f"{c.chunk_type}:{c.section}" for c in chunking.chunk_document(t)), ["Core Terms\n\nLoan Limit: the most that may be lent.", "Needs:\n- payslip\n- ledger", "| a | b |\n|---|---|\n| 1 | 2 |", "Year  Rate  Fee\n2020  1.5  20\n2021  1.7  30", ""], ["definition:Core Terms", "checklist:None", "table:None", "table:None", ""])
texts("fx_recursive", lambda t: joined(chunking.recursive_chunks(t, 6)), ["One two three. Four five. Six seven eight nine.", ""], ["One two three.|Four five.|Six seven eight nine.", ""])
texts("fx_acronyms", lambda t: joined(f"{a}={b}" for a, b in harvest.acronyms(t)), ["The Loan to Value (LTV) matters. DTI: Debt to Income.", "Nothing (XYZ) fits"], ["ltv=loan to value|dti=debt to income", ""])
fixture("fx_table_rendered", "r array<array<string>>", [([["a", "b"], ["1"]],), ([],)], lambda df: T.render_markdown_table("r"), ["| a | b |\n| --- | --- |\n| 1 |  |", ""])
fixture("fx_sidecar_written", "d string, p string, c string, u bigint", [("policy", "", "CL-1", 7), ("", None, None, 0)], lambda df: metadata.write_sidecar("d", "p", "c", "u"), ['{"doc_type":"policy","client_id":"CL-1","uploaded_by":7}', None])
texts("fx_sidecar_read", lambda c: F.to_json(metadata.read_sidecar(c)), ['{"doc_type": "policy", "department": 3, "uploaded_by": "12", "x": 1}', "{broken", '{"uploaded_by": true, "client_id": ""}', '{"uploaded_by": 0}', "[1]", None], ['{"doc_type":"policy","uploaded_by":12}', "{}", "{}", "{}", "{}", "{}"], None)
texts("fx_doc_type_valid", lambda c: metadata.valid(c, metadata.DOC_TYPES, metadata.AUTO), ["policy", "auto", "zzz", None], [True, True, False, False], None, "BOOLEAN")
fixture("fx_sizes", "b bigint", [(12,), (2048,), (1536,), (5767168,), (20971520,)], lambda df: metadata.readable_size("b"), ["12 B", "2 KB", "1.5 KB", "5.5 MB", "20 MB"])
fixture("fx_uploads", "f string, s bigint", [("a.txt", 10), ("../a.txt", 10), ("a.exe", 10), ("a.pdf", 30000000), ("", 1), ("a.txt", 0)], lambda df: scope.upload_error("f", "s", [".txt", ".pdf"], 20971520), [None, "path in name", "suffix not allowed", "too large", "empty name", "empty file"])
fixture("fx_mentions", "t string", [("Velder and the velderX",), ("nothing",), ("A REPORT",)], lambda df: F.array_join(F.transform(ingest.mentioned("t", df.sparkSession.createDataFrame([("velder", "velder bank", "lender"), ("vb", "velder bank", "lender"), ("report", "credit report", "document"), ("ltv", "ltv", "metric")], "alias string, canonical string, type string"), ["lender", "document"]), lambda e: e["entity"]), "|"), ["velder bank", "", "credit report"])
fixture("fx_user_error", "e string, r string, d string, taken boolean, a string", [("a@x", "processor", "general", False, "admin"), ("ax", "processor", "general", False, "admin"), ("a@x", "manager", "general", False, "admin"), ("a@x", "manager", "general", False, "super_admin"), ("a@x", "processor", "zzz", False, "admin"), ("a@x", "processor", "general", True, "admin")], lambda df: store.user_error(F.col("e"), F.col("r"), F.col("d"), F.col("taken"), F.col("a"), metadata.DEPARTMENTS), [None, "invalid address", "role not allowed", None, "unknown department", "address taken"])
fixture("fx_array_remove", "a array<string>", [(["x", "y", "x"],), (["y"],), (None,)], lambda df: F.array_join(store.remove("a", "x"), "|"), ["y", "y", None])

# --- evaluation ----------------------------------------------------------------------------


def fx_graded(spark, sf_dir):
    b = lambda *xs: list(xs)
    rows = [(1, "all", ["fee", "9"], b(("answer", "Fee is 9"), ("answer", "x"))), (2, "all", ["fee"], b(("no_answer", "fee"))), (3, "none", [], b(("no_answer", "x"))), (4, "none", [], b(("partial", "x"))), (5, "each", ["a.c", "zz"], b(("answer", "ABC"), ("partial", "zz top"))), (6, "each", ["q"], b(("answer", "r")))]
    cases = spark.createDataFrame(rows, "n int, kind string, patterns array<string>, blocks array<struct<routing:string,text:string>>")
    return metrics.graded(cases).select("n", F.col("passed").alias("result"))


def fx_processing_accuracy(spark, sf_dir):
    rows = [("limits", ["a"], 1, ["limits"], ["a", "b"]), ("general", [], 2, ["x"], []), ("costs", ["z"], 1, ["limits"], ["a"]), ("costs", [], 2, ["costs", "costs"], [])]
    return metrics.processing_accuracy(spark.createDataFrame(rows, "expected_intent string, expected_entities array<string>, expected_parts int, intents array<string>, entities array<string>"))


def fx_topic_ids(spark, sf_dir):
    """A set-valued map from keyword topics to the ids of chunks that mention them."""
    rows = spark.createDataFrame([(1, "Rate lock fee"), (2, "the FEE of a survey"), (3, "none"), (2, "fee")], "id int, t string")
    topics = {"fee": "costs", "survey": "property", "lock": "rates"}
    found = rows.select("id", F.explode(F.filter(F.array(*[F.when(F.contains(F.lower("t"), F.lit(k)), F.lit(v)) for k, v in topics.items()]), lambda x: x.isNotNull())).alias("topic"))
    return found.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("ids"))


for _f, _s in (
    (fx_graded, "SELECT n::INT AS n, result FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, true), (6, false)) v(n, result)"),
    (fx_processing_accuracy, 'SELECT 4::BIGINT AS n, 0.75 AS intent, 0.75 AS entity, 0.75 AS parts, 0.5 AS "all"'),
    (fx_topic_ids, "SELECT topic, ids FROM (VALUES ('costs', '1,2'), ('property', '2'), ('rates', '1')) v(topic, ids)"),
):
    _QUERIES[_f.__name__], _ORACLES[_f.__name__] = _f, _s
