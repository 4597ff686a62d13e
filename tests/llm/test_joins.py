"""Line ends at a hyphen: joined without it, joined with it, or left alone."""

import random

import pytest

from skein.llm import scan

WORDS = "the account closing statement month payment every under officer signed document review long short term rate fees costs known well view and both need".split()


@pytest.fixture(scope="module")
def editor():
    return scan.CharacterEditor({w: 100 for w in WORDS}).fit(1500)


def test_made_ends(editor):
    held = scan._made_ends(random.Random(77), sorted(w for w in WORDS if len(w) > 2), editor.lexicon, 2000)
    right = sum(editor.ends.best(features, classes) == label for features, label, classes in held)
    assert {label for _, label, _ in held} == set(scan.JOINS)
    assert right / len(held) > 0.93


@pytest.mark.parametrize(
    "page,kinds,text",
    [
        ("The docu-\nment is signed.", {"hyphen_break"}, "The document is signed."),
        ("The docu-\r\nment is signed.", {"hyphen_break"}, "The document is signed."),
        ("Need a long-\nterm view.", {"hyphen_break"}, "Need a long-term view."),
        ("Both short-\nand long-term fees", set(), "Both short- and long-term fees"),
        ("A Known Long-\nto-Short account", {"hyphen_break"}, "A Known Long-to-Short account"),
        ("- pre-\n- post-\n- sub-\n- well", set(), "- pre-\n- post-\n- sub-\n- well"),
        ("The officer signed the docu-", {"hyphen_break"}, "The officer signed the docu-"),
    ],
)
def test_line_ends(editor, page, kinds, text):
    assert scan.analyse(page, editor, scan.line_model(), repair=True) == (kinds, text)


def test_bullets_are_predicted():
    words = {w: 9 for w in "payment document information account statement copy signed letter recent of the".split()}
    editor = scan.CharacterEditor(words).fit(600)
    lines = ["Please bring:", "e signed letter", "e recent statement", "e copy of the account", ""]
    assert [editor.bullet(lines, i) for i in range(5)] == ["K", "R", "R", "R", "K"]
    assert scan.analyse("\n".join(lines), editor, scan.line_model(), repair=True)[1].count("- ") == 3
    assert editor.bullet(["* signed letter", "* recent statement"], 0) == "K"
    blind = scan.CharacterEditor(words)  # not fitted: nothing is found
    blind.starts.best = lambda *_: "K"
    assert "misread" not in scan.analyse("\n".join(lines), blind, scan.line_model())[0]


def test_long_lines_and_words():
    model = scan.line_model()
    header = "Northern Meters And Gardens Company Limited | Handbook For The Winter Season And All Of Its Valves | For Staff Only In All Of The Regional Offices And Depots Of The Firm"
    assert len(header) > 150
    body = "The garden was long and the river ran by the window of the museum."
    pages = [f"{header}\n{body}\n{body}" for _ in range(4)]
    repeated = scan.Counter({scan._line_key(header): 4, scan._line_key(body): 1})
    assert scan.label_lines(pages[1].split("\n"), 2, 4, repeated, model)[0] == "running_header"
    long_word = "information" * 5
    editor = scan.CharacterEditor({long_word: 9, "account": 5}).fit(300)
    assert dict(scan.repairs("0" + long_word[1:].replace("o", "0", 1), {"o" + long_word[1:]: 1}))
    assert scan.repairs("1nf0rm1t10n11", {"informition1l": 1}) == []  # four edits are too many
    assert editor.longest == len(long_word)
