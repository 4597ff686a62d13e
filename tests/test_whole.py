"""Queries over every row, also those SQL cannot check, against brute force in Python."""

import hashlib
import json
import re

import pytest

from skein.plans import catalog

TEXTS = [
    "Plain Text\nmore", "  plain text\nMORE\n", "Umowa KREDYTOWA – “Łódź”\nZażółć", " umowa kredytowa – “łódź”\nzażółć　", "合同 标题\n内容", "合同 标题\n内容", "ऋण अनुबंध\nपाठ", "عقد القرض\nنص", "ÉCOLE", "école ",
    "łódź bez tytułu\nDruga Linia", " ".join(["słowo"] * 12) + " Łódź\nTytuł", "ł" * 100, "", None,
]


@pytest.fixture
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def run(spark, where, name):
    return sorted(tuple(r) for r in catalog.queries()[name](spark, where).collect())


def test_content_hash_dedup(spark, tables):
    where = tables("documents", list(enumerate(TEXTS)), "doc_id bigint, text string")
    first = {}
    for i, t in enumerate(TEXTS):
        if t is not None:
            first.setdefault(hashlib.sha256(t.strip().lower().encode()).hexdigest(), i)
    assert len(first) < len([t for t in TEXTS if t is not None]) - 3
    assert run(spark, where, "content_hash_dedup") == sorted((i, h) for h, i in first.items())


def test_guess_title(spark, tables):
    where = tables("documents", list(enumerate(TEXTS)), "doc_id bigint, text string")

    def title(t):
        lines = [x.strip() for x in t.split("\n") if x.strip()][:5]
        return next((x for x in lines if len(x.split()) <= 12 and not x.islower()), lines[0][:80] if lines else None)

    got = catalog.queries()["guess_title"](spark, where).collect()
    assert {r["doc_id"]: r["title"] for r in got} == {i: title(t) for i, t in enumerate(TEXTS) if t is not None}


def test_bullet_repair(spark, tables):
    pages = [f"Liste à puces\n{b} première\n\t{b}  zażółć\r\n{b} third\nword{b} stays\n{b}stays\n{b} \n" for b in "e•·o©"] + ["\u2028• stays\r• stays\n•  stays", "", None]
    where = tables("extracted_texts", [(7, pages), (8, None)], "file_id bigint, pages array<string>")
    want = [re.sub(r"(?m)^[ \t]*[e•·o©][ \t]+(?=\S)", "- ", p) for p in pages if p is not None]
    assert all(p.count("- ") == 3 for p in want[:5])
    assert run(spark, where, "bullet_repair") == [(7, i, p) for i, p in enumerate(want, 1)]


CONTENTS = [
    "Zażółć gęślą. Jaźń!\u00a0Łódź? tak", "“Quoted” start. Next", "合同。内容. 第二", "\u00a0École\nTitre court\nUne phrase.", "łódź mała\n" + "ł" * 81, "• bullet – dash\nÉté !", "٣ أيام. نص", "ऋण. पाठ\n\u3000\nशीर्षक",
    "é" * 150 + " " + "ü" * 100, "😀" * 201, "😀" * 200, "słowo " * 60, "tab\tand\rreturn. Yes", "", None,
]


def test_chunk_queries(spark, tables):
    where = tables("document_chunks", list(enumerate(CONTENTS)), "id bigint, content string")

    def short(t):
        head = t[:199]
        return t if len(t) <= 200 else (head[: head.rindex(" ")] if head.rfind(" ") > 100 else head) + "…"

    rules = {
        "sentence_split_counts": lambda t: len([x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x]),
        "starts_cleanly": lambda t: (s := t.lstrip()) != "" and (s[0].isupper() or s[0].isdecimal() or s[0] in "\"'*-•|"),
        "truncate_excerpt": short,
        "heading_lines": lambda t: sum(0 < len(s) <= 80 and s[-1] not in ".!?" for s in map(str.strip, t.split("\n"))),
    }
    for name, rule in rules.items():
        assert run(spark, where, name) == [(i, rule(t)) for i, t in enumerate(CONTENTS) if t is not None], name


ASKED = ["What's the rate-lock/limit?", "$100,000 at 30%", "Kredyt hipoteczny – Łódź?", "合同 期限；", "mean\u00a0“APR”", 'a "quoted" \\ path', "tab\there", "plain", "", None]


def test_audit_queries(spark, tables):
    rows = [(i, 40 + i, t) for i, t in enumerate(ASKED)]
    where = tables("audit_log", [*rows, rows[0], (99, None, "nobody asks")], "id bigint, user_id bigint, query string")
    clean = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s%$.\-']+", " ", t)).strip()
    assert run(spark, where, "clean_search") == [(i, clean(t)) for i, _, t in rows if t is not None] + [(99, "nobody asks")]
    key = lambda u, t: hashlib.sha256(json.dumps({"query": t.lower(), "user": u}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert run(spark, where, "cache_keys") == [(i, key(u, t)) for i, u, t in rows if t is not None]
