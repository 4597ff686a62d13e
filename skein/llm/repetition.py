"""Repetition inside single documents: rule statistics and an isolation forest over them.

One pass computes rule statistics of each document, above all the share of its words that lie in
a sequence of five words occurring more than once in it.  An isolation forest, grown in numpy on
the ordinary rows of a bounded labelled sample, scores how few random splits set a document apart
from those.  The score from which a document counts as repetitive is calibrated on labelled rows:
on all of them, by the best F1 over a histogram of scores.  The score alone decides.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .neardup import Codes

GRAM = 5
STATS = ("share", "top_gram", "line_share", "poor_words", "run_share")
#: The forest's trees, and the ordinary rows each is grown on.
TREES, TREE_ROWS = 100, 4096
_WORD = re.compile(r"[^ \t\r\n]+")
_LINE = re.compile(r"[\r\n]+|(?<=[.!?])[ \t]+")
#: At most so many rows of statistics are brought to the driver to grow and calibrate the forest.
FIT_ROWS = 20_000


def statistics(text: str | None, known: Codes | None = None) -> tuple[int, ...]:
    """(number of words, *STATS) of a text; zeros for null, empty and blank ones."""
    known = Codes() if known is None else known
    lowered = text.lower() if text else ""
    words = _WORD.findall(lowered)
    n = len(words)
    if not n:
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    codes = known.of(words)
    share = top = run = 0.0
    m = n - GRAM + 1
    if m > 1:
        grams = codes[:m].copy()
        for j in range(1, GRAM):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m]
            grams ^= grams >> np.uint64(29)
        _, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        if again.any():
            marks = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(again)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + GRAM, -1)
            covered = np.cumsum(marks)[:n] > 0
            share = float(covered.mean())
            top = float(min(1.0, counts.max() * GRAM / n)) if counts.max() > 1 else 0.0
            edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
            run = float((edges[1::2] - edges[::2]).max() / n)
    lines = [x.strip() for x in _LINE.split(lowered)]
    sizes: dict[str, list[int]] = {}
    for x in lines:
        if x:
            sizes.setdefault(x, []).append(len(x))
    total = sum(sum(v) for v in sizes.values()) or 1
    repeated = sum(sum(v) for v in sizes.values() if len(v) > 1) / total
    poor = 1.0 - len(set(words)) / n if n >= 50 else 0.0
    return (n, share, top, repeated, poor, run)


class IsolationForest:
    """Random split trees; ``score`` is near 1 for rows that few splits set apart."""

    def __init__(self, trees: int = TREES, sample: int = TREE_ROWS, seed: int = 11):
        self.trees, self.sample, self.seed, self.grown = trees, sample, seed, []

    def fit(self, rows: np.ndarray) -> "IsolationForest":
        rng = np.random.default_rng(self.seed)
        self.size = max(2, min(self.sample, len(rows)))
        depth = int(np.ceil(np.log2(self.size)))
        self.grown = [self._grow(rows[rng.choice(len(rows), min(self.size, len(rows)), replace=False)], depth, rng) for _ in range(self.trees)]
        return self

    @staticmethod
    def _expected(n: float) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1 + 1e-12) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rows: np.ndarray, depth: int, rng) -> np.ndarray:
        nodes: list[list[float]] = []  # feature, split, left, right, path length

        def add(part: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, level + self._expected(len(part))])
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
            if level < depth and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                split = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                low = part[:, f] < split
                nodes[at][:2] = [f, split]
                nodes[at][2] = add(part[low], level + 1)
                nodes[at][3] = add(part[~low], level + 1)
            return at

        add(rows, 0)
        return np.array(nodes)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree in self.grown:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                f = tree[at, 0].astype(np.int64)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                low = rows[inner, f[inner]] < tree[at[inner], 1]
                at[inner] = np.where(low, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
            total += tree[at, 4]
        return 2.0 ** (-total / len(self.grown) / max(self._expected(self.size), 1e-9))


def made_texts(count: int = 300, seed: int = 5) -> list[str]:
    """Documents with known amounts of repetition, from none to all, for calibration."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    lexicon = [word() for _ in range(3000)]
    found = []
    for i in range(count):
        n, wanted = rng.randint(60, 600), (i % 10) / 9
        body = [rng.choice(lexicon) for _ in range(n)]
        phrase = [rng.choice(lexicon) for _ in range(rng.randint(5, 30))]
        while len(phrase) * 2 <= wanted * n and sum(1 for _ in body) and wanted:
            at = rng.randrange(len(body) + 1)
            body[at:at] = phrase
            if len(body) >= n / max(1e-9, 1 - wanted) or len(body) > 4 * n:
                break
        found.append(" ".join(w + ("." if rng.random() < 0.08 else "") for w in body))
    return found


def seen(values: np.ndarray, least_words: int) -> np.ndarray:
    """What the forest looks at, of rows (n_words, *STATS): the share of repeated words, none for short texts."""
    return np.where(values[:, 0] >= least_words, values[:, 1], 0.0)[:, None]


def labels(values: np.ndarray, least_share: float, least_words: int) -> np.ndarray:
    return (values[:, 1] >= least_share) & (values[:, 0] >= least_words)


def fitted(sample: np.ndarray, made: np.ndarray, least_share: float, least_words: int) -> IsolationForest:
    """A forest over the ordinary ones of the sample's rows and of the made texts."""
    rows = np.concatenate([made, sample]) if len(sample) else made
    return IsolationForest().fit(seen(rows[~labels(rows, least_share, least_words)], least_words))


def threshold(counts: list[tuple[float, bool, int]]) -> float:
    """The score with the best F1 over rows (score, whether repetitive, how many), between it and the next."""
    scores = sorted({s for s, *_ in counts}, reverse=True)
    right, every = dict.fromkeys(scores, 0), dict.fromkeys(scores, 0)
    for s, label, n in counts:
        every[s] += n
        right[s] += n if label else 0
    positives, best, at, tp, found = sum(right.values()), 0.0, float("inf"), 0, 0
    for i, s in enumerate(scores):
        tp, found = tp + right[s], found + every[s]
        if positives and 2 * tp / (positives + found) > best:
            best, at = 2 * tp / (positives + found), (s + scores[i + 1]) / 2 if i + 1 < len(scores) else s
    return at


def measure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, ``n_words`` and the rule statistics of every row; null texts give zeros."""
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Codes()
        for batch in batches:
            values = np.array([statistics(t, known) for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, 1 + len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[:, 0].astype(np.int64)), *(pa.array(values[:, i + 1]) for i in range(len(STATS)))], names=["k", "n_words", *STATS])

    columns = ", ".join(f"{c} double" for c in STATS)
    return source.mapInArrow(run, f"k {source.schema['k'].dataType.simpleString()}, n_words bigint, {columns}").withColumnRenamed("k", id_col)


def repetition(df: DataFrame, id_col: str, text_col: str, least_share: float = 0.3, least_words: int = 50, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, ``n_words``, ``share`` of repeated words,
    the forest's ``score`` and whether the document ``repeats``.

    ``repeats`` is decided by the score: from the threshold on, calibrated on rows labelled by the
    rule (at least ``least_words`` words and ``least_share`` of them repeated).  Null, empty and
    blank texts have share 0; repeated rows are all kept; extra columns are not read.  The made
    texts count beside a table's rows, so that a table without repetitive rows has a threshold too.
    """
    stats = settle(measure(df, id_col, text_col), "stats")
    rows = stats.count()
    # an even sample by hash, bounded whatever the table's size
    part = stats.where(F.pmod(F.xxhash64(*stats.columns), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(1, rows)))).select("n_words", *STATS).limit(2 * fit_rows).toPandas().to_numpy(dtype=np.float64)
    made = np.array([statistics(t) for t in made_texts()])
    forest = fitted(part, made, least_share, least_words)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(seen(np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1), least_words)).round(5))

    scored = settle(stats.withColumn("score", score("n_words", *STATS)), "scored")
    label = (F.col("n_words") >= least_words) & (F.col("share") >= least_share)
    counts = scored.groupBy("score", label.alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()  # scores have five places: a bounded histogram
    of_made = zip(forest.score(seen(made, least_words)).round(5).tolist(), labels(made, least_share, least_words).tolist())
    least = threshold([*(tuple(r) for r in counts), *((s, label, 1) for s, label in of_made)])
    return scored.select(id_col, "n_words", F.round("share", 6).alias("share"), "score", (F.col("score") >= least).alias("repeats"))
