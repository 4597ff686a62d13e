"""Acronyms from running text, and extractive summaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CONNECTIVES

_SMALL = frozenset(CONNECTIVES)
#: How acronyms are introduced (fixed values).
_BRACKETED = re.compile(r"((?:[A-Z][a-zA-Z']+[\s/-]+|[a-z]{2,3}[\s/-]+){1,10})\(([A-Z][A-Z0-9]{1,10})\)")
_LEADING = re.compile(r"\b([A-Z][A-Z0-9]{1,10})\b\s*[-—:]\s*([A-Za-z][A-Za-z ,&'/-]{1,160}?)(?=[.!?;]|\n|$)")


def _phrase(text: str) -> list[str]:
    """The leading run of capitalised words and connectives, without connectives at its ends."""
    found = []
    for w in re.findall(r"[A-Za-z0-9&'-]+", text):
        if not w[0].isupper() and w.lower() not in _SMALL:
            break
        found.append(w.lower())
    while found and found[0] in _SMALL:
        del found[0]
    while found and found[-1] in _SMALL:
        del found[-1]
    return found


def _spells(words: list[str], acronym: str) -> bool:
    parts = [p for p in re.split(r"[\s/-]+", " ".join(words)) if p]
    return acronym in ("".join(p[0] for p in parts), "".join(p[0] for p in parts if p not in _SMALL))


def acronyms(text: str | None) -> list[tuple[str, str]]:
    """(acronym, full term) pairs; the first meaning of an acronym in a text wins."""
    found: dict[str, str] = {}
    pairs = [(m.group(2), m.group(1)) for m in _BRACKETED.finditer(text or "")] + [(m.group(1), m.group(2)) for m in _LEADING.finditer(text or "")]
    for short, long in pairs:
        alias, words = short.lower(), _phrase(long)
        span = next((words[i:] for i in range(len(words)) if _spells(words[i:], alias)), None)
        term = " ".join(span or [])
        if len(alias) > 1 and len(term) > 2 and alias not in term:
            found.setdefault(alias, term)
    return list(found.items())


def summary(text: str | None, sentences: int = 2) -> str | None:
    """The ``sentences`` strongest sentences by latent semantic analysis, in their order."""
    if not text or len(text) < 100:
        return None
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(parts) <= sentences:
        return " ".join(parts)
    bags = [re.findall(r"[^\W\d_]{3,}", s.lower()) for s in parts]
    terms = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
    if not terms:
        return None
    m = np.zeros((len(terms), len(parts)))
    for j, b in enumerate(bags):
        for w in b:
            m[terms[w], j] += 1
    _, strength, vectors = np.linalg.svd(m, full_matrices=False)
    weight = np.sqrt(((strength[:3, None] * vectors[:3]) ** 2).sum(axis=0))
    return " ".join(parts[i] for i in sorted(np.argsort(-weight, kind="stable")[:sentences]))


def acronym_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, a, t) for k, text in zip(b["k"], b["t"]) for a, t in acronyms(text)], columns=["k", "alias", "canonical"])

    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    return source.mapInPandas(run, f"k {source.schema['k'].dataType.simpleString()}, alias string, canonical string").withColumnRenamed("k", id_col)


def summarise(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: summary(t) if isinstance(t, str) else None)

    return df.select(id_col, run(text_col).alias("summary"))
