"""Fusion, splitting, repetition, markup, scans and personal data on small fixtures."""

import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import fusion, markup, pii, repetition, scan, splitting

LANES = {"a": 1.0, "b": 1.0}


def test_fusion_ignores_range(spark):
    rng = random.Random(0)
    rows = [(1, i, rng.gauss(5, 1), rng.gauss(0, 0.1), "z") for i in range(40)]
    rows += [(1, 100, 9.0, 0.4, "z"), (1, 101, 900.0, -0.3, "z"), (1, 102, None, None, "z"), (1, 100, 9.0, 0.4, "z"), (2, 5, 1.0, None, "z"), (2, 6, 1.0, None, "z"), (None, 7, 1.0, float("nan"), "z")]
    df = spark.createDataFrame(rows, "q int, item int, a double, b double, score string")
    scores = fusion.combined_scores(df, ["q"], "item", LANES)
    first = {r["item"] for r in fusion.top(scores, ["q"], "item", 1).where("q = 1").collect()}
    assert first == {100}
    scaled = fusion.combined_scores(df.withColumn("a", df["a"] * 1000 + 7), ["q"], "item", LANES)
    order = lambda s: [r["item"] for r in s.where("q = 1").orderBy("score", "item").collect()]
    assert order(scores) == order(scaled)
    places = {(r["q"], r["item"]): r["place"] for r in fusion.ranked(scores, ["q"], "item").collect()}
    assert len(places) == 46 and places[2, 5] == 1 and places[2, 6] == 2 and places[None, 7] == 1
    assert places[1, 102] == 43 or places[1, 102] > 30
    assert fusion.ranked(scores.limit(0), ["q"], "item").count() == 0


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, "Para one. " * 60 + "\n\n" + "Next part, here; more. " * 90, "中文。" * 1200, "# Head\n" + "- item\n" * 500, " \n" * 2000])
def test_splitting_invariants(text):
    pieces = splitting.split_text(text, 1500, 100)
    assert "".join(text[own:end] for _, own, end in pieces) == text
    assert all(end - start <= 1500 for start, _, end in pieces)
    assert all(own - start <= 100 for start, own, _ in pieces) and pieces[0][0] == 0


def test_splitting_prefers_paragraphs(spark):
    text = ("One two three. " * 60).strip() + "\n\n" + ("Four five six. " * 60).strip()
    assert text[splitting.split_text(text, 1500, 0)[0][2] :].startswith("Four")
    df = spark.createDataFrame([(1, text, "S"), (2, "short", "S"), (3, None, "S"), (4, "", "S")], "id bigint, content string, piece string")
    rows = splitting.split_oversized(df, "id", "content", ["piece"], 1500, 100)
    assert rows.columns == ["id", "piece_no", "piece", "start", "own_start", "piece"]
    assert splitting.split_text(None) == splitting.split_text("") == []


def test_repetition(spark):
    rng = random.Random(1)
    fresh = " ".join(f"w{rng.randrange(9999)}" for _ in range(300))
    spam = "buy this now or never again friend. " * 40
    words = fresh.split()
    half = " ".join(words[:150] + words[:150][:75] + words[150:225])
    df = spark.createDataFrame([(1, fresh, "t"), (2, spam, "t"), (3, None, "t"), (4, "", "t"), (5, "a b a b", "t"), (6, half, "t"), (2, spam, "t")], "doc_id bigint, text string, share string")
    rows = repetition.repetition(df, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in rows if r["repeats"]) == [2, 2, 6]
    share = {r["doc_id"]: r["share"] for r in rows}
    assert share[2] == 1.0 and share[1] == share[3] == share[4] == 0.0 and abs(share[6] - 0.5) < 0.01
    assert repetition.repetition(df.limit(0), "doc_id", "text").count() == 0


def test_the_forest_decides(spark, monkeypatch):
    """Without the forest's scores no document stands out."""
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)) if i % 4 else "over and over it says the same. " * 12) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    flagged = lambda: {r["doc_id"] for r in repetition.repetition(df, "doc_id", "text").where("repeats").collect()}
    assert flagged() == {i for i in range(40) if i % 4 == 0}
    blind = repetition.IsolationForest()
    blind.grown, blind.size = [np.array([[-1.0, 0.0, 0.0, 0.0, 5.0]])], 2  # one leaf: every row has one score
    monkeypatch.setattr(repetition, "fitted", lambda *_: blind)
    assert len(flagged()) == 40


def test_repetition_share_equals_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert repetition.statistics(" ".join(w))[1] == pytest.approx(len(covered) / len(w) if w else 0)


@pytest.mark.parametrize("text,kinds", [
    ("<p>Hello <b>you</b></p>", ["html"]), ("Fish &amp; chips&nbsp;here", ["html"]), ("## Head\n\nSome **bold** text", ["markdown"]), ("See [[Page|this]] and '''that'''", ["wiki"]), ("\\section{A} and \\textbf{b} 5\\%", ["latex"]),
    ("Enter <your name> here", []), ("a < b and 3 > 2", []), ("- item\n* item\n1. item", []), ("Cost | Time\n3 | 4", []), ("Tick [x] or [ ]", []), ("C:\\temp\\open it", []), ("snake_case_name and file_v2.pdf", []), ("# of units: 4", []),
    ("", []), (None, []), ("<h1>A</h1>\n\n== B ==\n[[c]]", ["html", "wiki"]),
])
def test_markup_kinds(text, kinds):
    assert markup.kinds_of(text) == kinds


def test_markup_clean():
    assert markup.clean("<h2>Head</h2><ul><li>one</li><li>two</li></ul>") == "## Head\n\n- one\n- two"
    assert markup.clean("Some **bold** and `code`") == "Some bold and `code`"
    assert markup.clean("\\section{A}\nText with \\emph{weight} and $x_1 \\leq 2$") == "# A\n\nText with weight and $x_1 \\leq 2$"
    assert markup.clean("plain text") == "plain text" and markup.clean(None) is None


def test_min_cut_against_all_labellings():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        value = lambda keep: sum(c for c, k in zip(costs, keep) if c > 0 and not k) + sum(-c for c, k in zip(costs, keep) if c < 0 and k) + sum(w for i, j, w in edges if keep[i] != keep[j])
        best = min(value([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert value(markup.min_cut(costs, edges)) == pytest.approx(best)


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "k"), (2, None, "k"), (3, "", "k"), (1, "<p>x</p>", "k")], "id bigint, content string, kinds string")
    assert sorted((r["row_id"], list(r["kinds"])) for r in markup.markup(df, "id", "content").collect()) == [(1, ["html"]), (1, ["html"]), (2, []), (3, [])]


@pytest.fixture(scope="module")
def editor():
    words = "the requirement account closing statement month reconcile payment normally household every under third escalated officer signed document review window flower".split()
    return scan.CharacterEditor({w: 100 for w in words}).fit(1200)


def test_character_editor(editor):
    assert [editor.edit(w) for w in ("rcquirement", "c1osing", "m0nth", "norrnally", "househo|d", "qzx9k1w", "requirement", "reqirement")] == ["requirement", "closing", "month", "normally", "household", None, None, None]


def test_scan_page(editor):
    page = "ACME GUIDE TO MONTHLY PAYMENT QC-12\nThe account require-\nment is signed and the c1osing\nPage 3 of 9\nstatement follows under review."
    repeated = Counter({scan._line_key("ACME GUIDE TO MONTHLY PAYMENT QC-12"): 3})
    kinds, text = scan.analyse(page, editor, scan.line_model(), 3, 9, repeated, True)
    assert kinds == {"hyphen_break", "misread", "running_header", "page_number"}
    assert text == "The account requirement is signed and the closing statement follows under review."
    assert scan.analyse("Plain text here.", editor, scan.line_model())[0] == set()


def test_scanned_rows(spark):
    chunks = spark.createDataFrame([(1, "The officer signed every docu-\nment under review.", "x"), (2, None, "x"), (3, "", "x")], "id bigint, content string, kinds string")
    files = spark.createDataFrame([(9, ["One page.", None, ""], "x"), (10, [], "x"), (11, None, "x")], "file_id bigint, pages array<string>, page_no string")
    a, b = scan.scanned(chunks, "id", "content", files, "file_id", "pages")
    assert {(r["row_id"], r["page_no"], tuple(r["kinds"])) for r in a.collect()} == {(1, 0, ("hyphen_break",)), (3, 0, ())}
    assert sorted((r["row_id"], r["page_no"]) for r in b.collect()) == [(9, 1), (9, 2), (9, 3)]
    a, b = scan.scanned(chunks.limit(0), "id", "content", files.limit(0), "file_id", "pages")
    assert a.count() == b.count() == 0


def test_pii_held_out():
    """F1 by text and type on sentences of another seed than the training's."""
    from skein.llm.pii_train import Maker

    maker = Maker(987654)
    samples = [maker.text() for _ in range(1500)]
    found = pii.find([t for t, _ in samples])
    tp = fp = fn = 0
    for (_, spans), items in zip(samples, found):
        want, got = {pii.TYPES[k] for *_, k in spans}, {k for *_, k in items}
        tp, fp, fn = tp + len(want & got), fp + len(got - want), fn + len(want - got)
    assert 2 * tp / (2 * tp + fp + fn) > 0.95


def test_pii_windows_and_redaction(spark):
    filler = "what is the limit on a payslip for the tracker. " * 12
    text = filler + "My mail is ana.velder@mail.example and call me on 617-555-0123. " + filler
    items = pii.find([text, None, "", "a" * 3000])
    assert [k for *_, k in items[0]] == ["email", "phone"] and items[1] == items[2] == []
    assert pii.redact(text, items[0]) == text.replace("ana.velder@mail.example", "[EMAIL]").replace("617-555-0123", "[PHONE]")
    df = spark.createDataFrame([(1, "email ana@mail.example bounced", "x"), (2, None, "x"), (1, "email ana@mail.example bounced", "x"), (3, "what is a payslip", "x")], "id bigint, query string, types string")
    source = [("t", df, "id", "query")]
    assert {tuple(r) for r in pii.found(source).collect()} == {("t", 1, "email")}
    assert sorted(str(r["redacted"]) for r in pii.redacted(source).collect()) == ["None", "email [EMAIL] bounced", "email [EMAIL] bounced", "what is a payslip"]
    assert pii.found([("t", df.limit(0), "id", "query")]).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    model = pii.tagger()
    scores = rng.standard_normal((1, 3, pii.TAGS)).astype(np.float32) * 3
    value = lambda p: model.start[p[0]] + scores[0, 0, p[0]] + sum(model.trans[p[i - 1], p[i]] + scores[0, i, p[i]] for i in (1, 2)) + model.end[p[2]]
    best = max(((a, b, c) for a in range(pii.TAGS) for b in range(pii.TAGS) for c in range(pii.TAGS)), key=value)
    assert tuple(model.decode(scores, np.array([3]))[0]) == best


def test_gradients():
    from skein.llm import pii_train as P

    w, batch = P.new_weights(5, 4), P.batch_of([P.Maker(2).text() for _ in range(3)])
    loss, grad = P.loss_and_gradients(w, *batch)
    for key, at in (("u", (1, 2, 7)), ("trans", (3, 4)), ("w", (0, 1, 9)), ("end", (0,))):
        kept = w[key][at]
        w[key][at] = kept + 1e-2
        up = P.loss_and_gradients(w, *batch)[0]
        w[key][at] = kept - 1e-2
        down = P.loss_and_gradients(w, *batch)[0]
        w[key][at] = kept
        assert (up - down) / 2e-2 == pytest.approx(float(grad[key][at]), abs=5e-3, rel=5e-2)


def test_minimum_cut_against_all_cuts():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 9)
        costs = [rng.choice([-3, -2, -1, 0, 1, 2, 3]) * 1.0 for _ in range(n)]
        edges = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def value(side):
            return sum(c for c, x in zip(costs, side) if c > 0 and not x) - sum(c for c, x in zip(costs, side) if c < 0 and x) + sum(w for a, b, w in edges if side[a] != side[b])

        sides = [[bool(k >> i & 1) for i in range(n)] for k in range(2**n)]
        least = min(map(value, sides))
        best = min((x for x in sides if value(x) == least), key=sum)
        assert markup.min_cut(costs, edges) == markup._max_flow(costs, edges) == best


def test_markup_has_no_limits():
    import time

    assert markup.kinds_of("$x_1 + " + "y + " * 60 + "z_2$") == ["latex"] and markup.kinds_of("a &alpha; &rarr; b") == ["html"] and markup.kinds_of("R&D; and AT&T&x; here") == []
    assert markup.kinds_of("&lt;p title='" + "x" * 300 + "'&gt;") == ["html"] and markup.kinds_of("[[" + "long page name " * 9) == ["wiki"]
    assert markup.clean("a <!-- x\ny\nz --> b") == "a  b"
    nested = "deep"
    for i in range(9):
        nested = ("\\textbf{", "\\emph{")[i % 2] + nested + "}"
    assert markup.clean(nested) == "deep"
    began = time.time()
    text = "5 < 7 <b>x</b> &amp; [[a]] # of rooms **c** <your name> C:\\section \\textbf{x}\n" * 1500
    assert len(markup.label(text)) > 7000 and time.time() - began < 3
