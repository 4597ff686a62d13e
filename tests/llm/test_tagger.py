"""The tagger's batches against one character at a time."""

import numpy as np

from skein.llm import pii

TEXTS = ["Ana Velder, ana@mail.example", None, "", "Été à l'İstanbul\nwith\0 nul", "x", "call 617-555-0123 \U0001f600 now", "word " * 60]


def test_symbols_of_many_texts(monkeypatch):
    coded = pii.symbols_of(TEXTS)
    known = pii.known_words()
    for text, found in zip(TEXTS, coded):
        wanted = [pii._class_of(ord(c)) if ord(c) < 0x3000 else pii._FIRST_CLASS + 4 for c in text or ""]
        for m in pii._LETTERS.finditer(text or ""):
            for i in range(*m.span()):
                wanted[i] += pii.CHARACTERS * known.get(m.group().lower(), 3)
        assert found.tolist() == wanted
    assert pii.symbols_of([]) == [] and pii.find([]) == []
    calls, plain = [], pii.symbols
    monkeypatch.setattr(pii, "symbols", lambda text: calls.append(text) or plain(text))
    assert pii.find(TEXTS * 50)[:3] == [pii.find([t])[0] for t in TEXTS[:3]]
    assert len(calls) == 4  # one look-up a call, not one a text


def test_scores_against_single_steps():
    model, lengths = pii.tagger(), np.array([28, 1, 9])
    rows = np.random.default_rng(3).integers(0, pii.SYMBOLS, (3, 28))
    got = model.scores(rows, lengths)
    with np.load(pii.MODEL) as stored:
        w = {k: stored[k].astype(np.float64) for k in stored.files}
    h, sigmoid = w["u"].shape[1], lambda x: 1 / (1 + np.exp(-x))
    for row, n, found in zip(rows, lengths, got):
        hidden = np.zeros((2, n, h))
        for d, order in enumerate((range(n), range(n - 1, -1, -1))):
            state = cell = np.zeros(h)
            for i in order:
                a, b, c, g = np.split(w["emb"][row[i]] @ w["w"][d] + w["b"][d] + state @ w["u"][d], 4)
                cell = sigmoid(b) * cell + sigmoid(a) * np.tanh(g)
                hidden[d, i] = state = sigmoid(c) * np.tanh(cell)
        wanted = hidden[0] @ w["out"][:h] + hidden[1] @ w["out"][h:] + w["out_b"]
        assert np.abs(found[:n] - wanted).max() < 1e-2  # 32 bits against 64


def test_things_are_nobody():
    """Names of things whose first word is a first name, or that are misspelt, and ends of account numbers."""
    things = ["minimum score for Willow Saver at 5%?", "max ltv for Willow Starter", "list documents for Willow Starter", "do I need a pricing grid for Willow Starter", "account ending 3444, is the consent form ok", "account ending 2825, is the identity check ok"]
    assert sum(map(bool, pii.find(things))) <= 1
    people = ["status of Sofia Marenko's consent form", "my name is Petra Yarosan and I need a copy", "please tell Ravi Ostmoran that it was wrong", "I live at 1024 Birchgate Avenue, Dunmarrow"]
    assert all(pii.find(people))
