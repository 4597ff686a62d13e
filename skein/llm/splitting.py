"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text starts as atomic segments: sentences, lines, list items, table rows and headings with
the white space that follows them; what is too long for a piece is cut at words, or, where there
are none, at characters.  Between neighbours lies a boundary with a strength: headings and
paragraphs are strong, sentence ends weaker, spaces weakest.  All adjacent pairs wait in a heap;
the weakest boundary that still fits the limit (with the overlap) is merged first, and short
segments before long ones, until nothing fits.  What remains are pieces whose borders are the
strongest there are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATOM = re.compile(r"\n\s*\n|\n|(?<=[.!?])[\"')\]]*\s+|(?<=[。!?;])|(?<=[;:,])\s+")
_HEADING = re.compile(r"\s*(#{1,6} |=+ |<h[1-6]|\\(?:sub)*section|[A-Z0-9][^.!?\n]{0,70}\n[-=]{3,}\s*\n)")
_ITEM = re.compile(r"\s*([-*•] |\d+[.)] |\|)")


def _strength(before: str, after: str) -> int:
    """How natural a cut between two neighbouring segments is."""
    gap = before[len(before.rstrip()) :]
    if _HEADING.match(after):
        return 6
    if gap.count("\n") > 1:
        return 5
    if "\n" in gap:
        return 3 if _ITEM.match(after) else 4 if before.rstrip()[-1:] in tuple(".!?:。!?") else 2
    end = before.rstrip()[-1:]
    if end in tuple(".!?。!?") and end:
        return 3
    return 1 if end and end in ";:,,;、" else 0


def atoms(text: str, limit: int) -> list[str]:
    """Segments that join to ``text``, none longer than ``limit``."""
    cuts, found, last = [m.end() for m in _ATOM.finditer(text)] + [len(text)], [], 0
    for cut in cuts:
        while cut - last > limit:
            space = max(text.rfind(c, last + 1, last + limit) for c in " \t\n")
            at = space + 1 if space > last else last + limit
            found.append(text[last:at])
            last = at
        if cut > last:
            found.append(text[last:cut])
            last = cut
    return found


def _overlap_start(text: str, at: int, overlap: int) -> int:
    """Where the piece that begins at ``at`` starts when it repeats what comes before.

    The nearest word start to ``overlap`` characters back, never further than that.
    """
    low = max(0, at - overlap)
    if low == 0 or text[low - 1].isspace():
        return low
    for i in range(low, min(at, low + overlap // 2)):
        if text[i - 1].isspace():
            return i
    return low


def split_text(text: str | None, limit: int = 1500, overlap: int = 100) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, own, end): ``text[start:end]`` is the piece, ``text[own:end]``
    what it adds; the own parts join to the text.  A text within the limit is one piece; null
    and empty give none.  ``overlap`` must be below ``limit``."""
    if not text:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap
    parts = atoms(text, room)
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + len(p))
    n = len(parts)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), starts[1:]
    alive, version = [True] * n, [0] * n

    def size(i: int, j: int) -> int:
        return end[j] - starts[i]

    def fits(i: int, j: int) -> bool:
        return size(i, j) <= (room if i else limit)

    heap: list[tuple[int, int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and fits(i, j):
            heapq.heappush(heap, (strength[j], size(i, j), i, j, version[i], version[j]))

    strength = [0] + [_strength(parts[i - 1], parts[i]) for i in range(1, n)]
    for i in range(n - 1):
        offer(i)
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        end[i], right[i], alive[j] = end[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
        version[i] += 1
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    found = []
    for i in range(n):
        if alive[i]:
            own = starts[i]
            found.append((_overlap_start(text, own, overlap) if i else 0, own, end[i]))
    return found


def split_oversized(df: DataFrame, id_col: str, text_col: str, keep: list[str], limit: int = 1500, overlap: int = 100) -> DataFrame:
    """Pieces of the texts above ``limit`` code points: ``id_col``, ``piece_no`` (from 1),
    ``piece``, ``start`` and ``own_start`` (offsets, from 0) and the columns ``keep``.

    Texts within the limit, null and empty ones give no row.  Repeated rows give repeated
    pieces; a column of ``keep`` may have any name.  No shuffle.
    """
    source = df.where(F.char_length(F.col(text_col)) > limit).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)] or [F.lit(None).cast("int").alias("c")]).alias("kept"))
    schema = f"k {source.schema['k'].dataType.simpleString()}, kept {source.schema['kept'].dataType.simpleString()}, piece_no bigint, piece string, start bigint, own_start bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, pieces, start, own = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for j, (a, b, c) in enumerate(split_text(text, limit, overlap)):
                    rows.append(i)
                    number.append(j + 1)
                    pieces.append(text[a:c])
                    start.append(a)
                    own.append(b)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array(number, pa.int64()), pa.array(pieces, pa.string()), pa.array(start, pa.int64()), pa.array(own, pa.int64())],
                names=["k", "kept", "piece_no", "piece", "start", "own_start"],
            )

    made = source.mapInArrow(run, schema)
    return made.select(F.col("k").alias(id_col), "piece_no", "piece", "start", "own_start", *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(keep)])
