"""Personal information inside free text: a character-level BiLSTM with CRF transitions.

Both directions' recurrences run in numpy over batches of windows.  Long texts are covered by
overlapping windows; where two cover a character, the scores of the one whose edge is further
away count, and one Viterbi pass with the CRF's transitions decodes the whole text, so a span is
never cut by a window.  A text whose best scores prove that no path can beat "all outside" skips
that pass; nothing else is skipped.

Besides the character, the network reads whether its word stands in a public tokenizer's vocabulary,
as names of things do and most names of people do not.  The weights in ``pii_model.npz`` are trained by ``pii_train`` on labelled spans made there.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER_DIR

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
#: O, then B and I of each type.
TAGS = 1 + 2 * len(TYPES)
WINDOW, STRIDE, BATCH = 128, 96, 256
MODEL = Path(__file__).with_name("pii_model.npz")

# --- characters ----------------------------------------------------------------------------

_DIRECT = {c: i + 1 for i, c in enumerate([chr(x) for x in range(32, 127)] + ["\n"] + [chr(x) for x in range(0xA0, 0x100)])}
_FIRST_CLASS = len(_DIRECT) + 1
#: Characters: 0 padding, single characters, then classes of all others.
CHARACTERS = _FIRST_CLASS + 7
#: What the word around a character is: none, a word of a public vocabulary, one that stands there
#: with a capital letter only, or neither.
WORD_KINDS = 4
#: Symbols of the network: a character beside the kind of its word.
SYMBOLS = CHARACTERS * WORD_KINDS


def _class_of(code: int) -> int:
    c = chr(code)
    if c in _DIRECT:
        return _DIRECT[c]
    if c.isspace():
        return _FIRST_CLASS
    if c.isdigit():
        return _FIRST_CLASS + 1
    if c.isalpha():
        return _FIRST_CLASS + (2 if c.isupper() else 3 if c.islower() else 4)
    return _FIRST_CLASS + (5 if 0x2010 <= code <= 0x2015 else 6)


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    table = np.full(0x3000, _FIRST_CLASS + 4, dtype=np.int16)
    for code in range(0x3000):
        table[code] = _class_of(code)
    return table


@lru_cache(maxsize=2)
def known_words(directory: str = TOKENIZER_DIR) -> dict[str, int]:
    """Words that are tokens of a public vocabulary: 1 in lower case, 2 with a capital letter only."""
    with open(os.path.join(directory, "byte_bpe_50k.tiktoken"), "rb") as lines:
        tokens = [base64.b64decode(x.split()[0]).decode("utf-8", "replace") for x in lines]
    whole = [t[1:] for t in tokens if t[:1] == " " and len(t) > 2 and t[1:].isalpha()]
    return {**{w.lower(): 2 for w in whole}, **{w: 1 for w in whole if w == w.lower()}}


_LETTERS = re.compile(r"[^\W\d_]+")


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    table = _symbol_table()
    found = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], _FIRST_CLASS + 4)
    known = known_words()
    words = [(m.start(), m.end(), known.get(m.group().lower(), 3)) for m in _LETTERS.finditer(text)]
    if words:  # words never touch: a kind begins at a word's start and ends at its end
        start, end, kind = np.array(words).T
        steps = np.zeros(len(found) + 1, dtype=found.dtype)
        steps[start] = kind * CHARACTERS
        steps[end] = -kind * CHARACTERS
        found += np.cumsum(steps[:-1], dtype=found.dtype)
    return found


def symbols_of(texts: list[str | None]) -> list[np.ndarray]:
    """:func:`symbols` of each text, looked up in one go; a text's end ends a word."""
    filled = [t or "" for t in texts]
    ends = np.cumsum([0, *(len(t) + 1 for t in filled)])
    whole = symbols("\0".join([*filled, ""]))
    return [whole[a : b - 1] for a, b in zip(ends[:-1], ends[1:])]


# --- the network ---------------------------------------------------------------------------


class Tagger:
    """``scores`` of shape (rows, length, TAGS) for padded symbol rows."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.hidden = weights["u"].shape[1]
        h = self.hidden
        # a sigmoid is a division by 1 + exp(-x), which is cheaper than a tanh: three gates are kept negated
        sign = np.concatenate([np.full(3 * h, -1), np.ones(h)]).astype(np.float32)
        inputs = ((weights["emb"] @ weights["w"]) + weights["b"][:, None, :]) * sign  # direction, symbol, gates
        self.inputs = np.ascontiguousarray(inputs.reshape(2, SYMBOLS, 4, h).transpose(0, 2, 1, 3), dtype=np.float32)  # direction, gate, symbol, unit
        self.u = np.ascontiguousarray((weights["u"] * sign).reshape(2, h, 4, h).transpose(0, 2, 1, 3), dtype=np.float32)  # direction, gate, unit, unit
        self.out, self.out_b = weights["out"].astype(np.float32), weights["out_b"].astype(np.float32)
        self.trans, self.start, self.end = (weights[k].astype(np.float32) for k in ("trans", "start", "end"))
        # against "all outside", a run of other tags gains at most its scores, a way in, a way out
        # and a step between them for each further character
        gains = self.trans - self.trans[0, 0]
        into = max(float(gains[0, 1:].max()), float((self.start - self.start[0])[1:].max()))
        out = max(float(gains[1:, 0].max()), float((self.end - self.end[0])[1:].max()))
        self.gain = max(into + out, float(gains[1:, 1:].max()))

    def scores(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n, t = rows.shape
        h = self.hidden
        hidden = np.zeros((2, n, h), dtype=np.float32)
        cell = np.zeros_like(hidden)
        kept = np.empty((2, t, n, h), dtype=np.float32)
        gates, taken = np.empty((2, 4, n, h), dtype=np.float32), np.empty((2, 4, n, h), dtype=np.float32)
        # the second direction reads each row from its own end
        back = np.maximum(lengths[:, None] - 1 - np.arange(t)[None, :], 0)
        columns = np.ascontiguousarray(np.stack([rows, np.take_along_axis(rows, back, 1)]).transpose(2, 0, 1))
        for i in range(t):
            np.matmul(hidden[:, None], self.u, out=gates)
            for d in (0, 1):
                np.take(self.inputs[d], columns[i, d], axis=1, out=taken[d], mode="clip")
            gates += taken
            for d in (0, 1):
                divisors, made = gates[d, :3], gates[d, 3]
                np.minimum(divisors, 80, out=divisors)  # exp stays finite; 1 / (1 + exp(80)) is nothing
                np.exp(divisors, out=divisors)
                divisors += 1
                np.tanh(made, out=made)
                made /= divisors[0]
                cell[d] /= divisors[1]
                cell[d] += made
                np.tanh(cell[d], out=kept[d, i])
                kept[d, i] /= divisors[2]
            hidden = kept[:, i]
        forward, backward = ((kept[d].reshape(t * n, h) @ self.out[d * h : (d + 1) * h]).reshape(t, n, TAGS) for d in (0, 1))
        found = backward[back, np.arange(n)[:, None]]
        found += forward.transpose(1, 0, 2)
        found += self.out_b
        return found

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best paths of a batch (rows, length, TAGS); beyond a row's length the path is 0."""
        n, t, _ = scores.shape
        by_tag = np.ascontiguousarray(scores.transpose(1, 2, 0))  # position, tag, row: rows are the inner loop
        steps = np.empty((t, TAGS, n), dtype=np.float32)
        steps[0] = by_tag[0] + self.start[:, None]
        ways = np.empty((TAGS, TAGS, n), dtype=np.float32)
        whole = int(lengths.min())
        for i in range(1, t):
            np.add(steps[i - 1][:, None, :], self.trans[:, :, None], out=ways)
            np.max(ways, axis=0, out=steps[i])
            steps[i] += by_tag[i]
            if i >= whole:  # rows that have ended keep their sums
                np.copyto(steps[i], steps[i - 1], where=(i >= lengths)[None])
        path = np.zeros((n, t), dtype=np.int8)
        tag = (steps[-1] + self.end[:, None]).argmax(axis=0)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            path[inside, i] = tag[inside]
            if i:
                before = (steps[i - 1] + self.trans[:, tag]).argmax(axis=0)
                tag = np.where(inside, before, tag)
        return path

    def may_deviate(self, scores: np.ndarray) -> bool:
        """False only if "all outside" is provably the best path."""
        return float((scores[:, 1:].max(axis=1) - scores[:, 0]).max()) + self.gain >= 0


def _spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type) of B I* runs."""
    found, i, n = [], 0, len(path)
    inside = np.flatnonzero(path)
    while len(inside):
        i = int(inside[0])
        kind, j = (path[i] - 1) // 2, i + 1
        while j < n and path[j] == 2 * kind + 2:
            j += 1
        found.append((i, j, int(kind)))
        inside = inside[inside >= j]
    return found


_DIGIT_WORDS = re.compile(r"(?i)\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b")


def _valid(kind: int, s: str) -> bool:
    """What a span of a type must have at least, whatever the network says."""
    digits = sum(map(str.isdigit, s))
    if TYPES[kind] == "email":
        return "@" in s or " at " in s.lower() or "(at)" in s.lower() or "[at]" in s.lower()
    if TYPES[kind] == "phone":
        return digits + len(_DIGIT_WORDS.findall(s)) >= 7
    if TYPES[kind] == "id_number":
        return digits >= 5
    if TYPES[kind] == "street_address":
        return digits >= 1 and sum(map(str.isalpha, s)) >= 3
    return sum(map(str.isalpha, s)) >= 3 and digits == 0 and len(_LETTERS.findall(s)) >= 2  # a family name and something before it


def _whole_words(kind: int, text: str, a: int, b: int) -> bool:
    """A name neither begins nor ends inside a word."""
    if TYPES[kind] != "person_name":
        return True
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " \t\r\n,;:.!?'\"":
        a += 1
    while b > a and text[b - 1] in " \t\r\n,;:!?'\"":
        b -= 1
    return a, b


@lru_cache(maxsize=1)
def tagger(path: str = str(MODEL)) -> Tagger:
    with np.load(path) as stored:
        return Tagger({k: stored[k] for k in stored.files})


def find(texts: list[str | None], model: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """For each text, its items as (start, end, type) in order.  Null and empty texts have none."""
    model = model or tagger()
    coded = symbols_of(texts)
    windows = [(i, a) for i, c in enumerate(coded) if len(c) for a in (range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE) if len(c) > WINDOW else (0,))]
    windows.sort(key=lambda w: min(WINDOW, len(coded[w[0]]) - w[1]))
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    def keep(i: int, path: np.ndarray) -> None:
        for a, b, kind in _spans(path):
            a, b = _trim(texts[i], a, b)
            if _valid(kind, texts[i][a:b]) and _whole_words(kind, texts[i], a, b):
                found[i].append((a, b, TYPES[kind]))

    for at in range(0, len(windows), BATCH):
        group = windows[at : at + BATCH]
        lengths = np.array([min(WINDOW, len(coded[i]) - a) for i, a in group])
        rows = np.zeros((len(group), int(lengths.max())), dtype=np.int64)
        for r, ((i, a), n) in enumerate(zip(group, lengths)):
            rows[r, :n] = coded[i][a : a + n]
        scores = model.scores(rows, lengths)
        suspect = (scores[:, :, 1:].max(axis=2) - scores[:, :, 0] + model.gain >= 0) & (np.arange(rows.shape[1]) < lengths[:, None])
        suspect = suspect.any(axis=1)
        short = np.array([len(coded[i]) <= WINDOW for i, _ in group])
        for r in np.flatnonzero(~short):
            i, a = group[r]
            parts.setdefault(i, []).append((a, scores[r, : lengths[r]].copy()))
        # rows where "all outside" is provably the best path need no decoding
        at_ = np.flatnonzero(short & suspect)
        if len(at_):
            for r, path in zip(at_, model.decode(scores[at_], lengths[at_])):
                keep(group[r][0], path[: lengths[r]])
    wholes: list[tuple[int, np.ndarray]] = []
    for i, own in parts.items():
        whole = np.zeros((len(coded[i]), TAGS), dtype=np.float32)
        distance = np.full(len(coded[i]), -1)
        for a, s in own:
            n = len(s)
            edge = np.minimum(np.arange(n) + (a == 0) * WINDOW, np.arange(n)[::-1] + (a + n == len(whole)) * WINDOW)
            closer = edge > distance[a : a + n]
            whole[a : a + n][closer] = s[closer]
            distance[a : a + n][closer] = edge[closer]
        if model.may_deviate(whole):
            wholes.append((i, whole))
    wholes.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(wholes):
        size = max(1, min(BATCH, 60_000 // len(wholes[at][1])))  # keeps a batch of long texts small
        group = wholes[at : at + size]
        lengths = np.array([len(x) for _, x in group])
        padded = np.zeros((len(group), int(lengths.max()), TAGS), dtype=np.float32)
        for r, (_, x) in enumerate(group):
            padded[r, : len(x)] = x
        for (i, x), path in zip(group, model.decode(padded, lengths)):
            keep(i, path[: len(x)])
        at += size
    return found


def redact(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    """The text with each item replaced by its type in brackets; all else unchanged."""
    if not text or not items:
        return text
    parts, at = [], 0
    for a, b, kind in items:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


def personal_information(texts: DataFrame) -> DataFrame:
    """``text`` (distinct, not null), ``types`` (array, in order of ``TYPES``) and ``redacted``.

    Every distinct text is looked at once, however often it occurs.
    """
    weights = tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            items = find(own, weights)
            types = [[t for t in TYPES if any(k == t for _, _, k in x)] for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(types, pa.list_(pa.string())), pa.array([redact(t, x) for t, x in zip(own, items)], pa.string())], names=["text", "types", "redacted"])

    return texts.select("text").where("text is not null").distinct().mapInArrow(run, "text string, types array<string>, redacted string")


def scan_tables(sources: list[tuple[str, DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """All rows of (name, table, id, text) sources, and :func:`personal_information` of them.

    Rows: ``source_table``, ``row_id``, ``text``.  Repeated rows are kept; null texts too.
    """
    rows = None
    for name, df, key, column in sources:
        part = df.select(F.lit(name).alias("source_table"), F.col(key).alias("row_id"), F.col(column).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    return rows, personal_information(rows)


def found(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Distinct ``source_table``, ``row_id``, ``pii_type``."""
    rows, seen = scan_tables(sources)
    holding = seen.where(F.size("types") > 0).select("text", "types")
    return rows.join(holding, "text").select("source_table", "row_id", F.explode("types").alias("pii_type")).distinct()


def redacted(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Every row with its text redacted: ``source_table``, ``row_id``, ``redacted``."""
    rows, seen = scan_tables(sources)
    changed = seen.where(F.size("types") > 0).select("text", F.col("redacted").alias("new"))
    return rows.join(changed, "text", "left").select("source_table", "row_id", F.coalesce("new", "text").alias("redacted"))
