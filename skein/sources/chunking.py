"""Structure-aware chunking of documents.

A text is cut into typed blocks (table, list, definition, heading, prose); a list keeps the line
that introduces it, headings become the section of what follows, prose is packed by sentences
and, where a sentence is too long, by clauses.  Small paragraphs join their neighbours.  The
whole fold of one document runs in one Arrow batch function.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT

_ITEM = re.compile(r"[-*]\s|\d+[.)]\s")
_TERM = re.compile(r"([^\n:]{2,70}):[ \t]+\S")
_SMALL_WORDS = frozenset("a an and at by for from in into of on or the to vs with".split())


@dataclass(frozen=True)
class Chunk:
    content: str
    section: str | None
    chunk_type: str
    page_number: int | None = None


def tokens(text: str) -> int:
    return int(len(text.split()) * DEFAULT.tokens_per_word)


def is_item(line: str) -> bool:
    return bool(_ITEM.match(line.strip()))


def title_like(text: str) -> bool:
    parts = text.split()
    return 0 < len(parts) <= 8 and all(w[0].isupper() or w[0].isdigit() or w.lower() in _SMALL_WORDS for w in (p.strip("()[]\"'&-—/") or "A" for p in parts))


def bare_label(line: str) -> bool:
    s = line.strip()
    return 0 < len(s.split()) <= 3 and s[-1] not in ".!?:;," and title_like(s)


def is_definition(block: str) -> bool:
    m = _TERM.match(block)
    return bool(m) and title_like(m.group(1))


def is_markup_table(block: str) -> bool:
    return sum(line.strip().startswith("|") for line in block.split("\n")) >= 2 or "<table" in block.lower()


def is_aligned_table(block: str) -> bool:
    """Two lines or more of as many cells as the first, but for one."""
    lines = [x.strip() for x in block.split("\n") if x.strip()]
    if len(lines) < 2:
        return False
    for gap in (r"\s{2,}", r"\s+"):
        cells = [len(re.split(gap, x)) for x in lines]
        if cells[0] >= 3 and sum(c == cells[0] for c in cells) >= max(2, len(lines) - 1):
            return True
    return False


def pack(pieces: list[str], limit: int, split: Callable[[str], Iterator[str]] | None = None) -> Iterator[str]:
    """Greedy packing: pieces are joined by spaces while they stay below ``limit`` tokens; a
    lone piece at the limit is split further, or passed on whole."""
    held: list[str] = []
    for piece in pieces:
        held.append(piece)
        if tokens(" ".join(held)) < limit:
            continue
        if len(held) > 1:
            yield " ".join(held[:-1])
            held = [piece]
        else:
            yield from split(piece) if split else iter([piece])
            held = []
    if held:
        yield " ".join(held)


def recursive_chunks(text: str | None, limit: int = DEFAULT.chunk_max_tokens) -> list[str]:
    if not text or not text.strip():
        return []
    clauses = lambda s: pack(re.split(r"(?<=[,;])\s+", s), limit)
    return list(pack(re.split(r"(?<=[.!?])\s+", text), limit, clauses))


def _prose(text: str, section: str | None, page: int | None, limit: int) -> Iterator[Chunk]:
    for part in [text] if tokens(text) <= limit else recursive_chunks(text, limit):
        yield Chunk(part, section, "paragraph", page)


def list_chunks(block: str, section: str | None, page: int | None) -> list[Chunk]:
    """A short list stays whole; a long one gives an item a chunk, led by its introduction."""
    lines = [x.strip() for x in block.split("\n")]
    items = [x for x in lines if is_item(x)]
    if not items:
        return []
    filled = [x for x in lines if x]
    if sum(map(len, filled)) <= 600 and sum(map(len, items)) / len(items) < 45:
        return [Chunk("\n".join(filled), section, "checklist", page)]
    groups: list[tuple[bool, list[str]]] = []
    fresh = True
    for line in lines:
        if not line:
            fresh = True
        elif is_item(line):
            groups.append((True, [line]))
            fresh = False
        elif fresh or not groups:
            groups.append((False, [line]))
            fresh = False
        else:
            groups[-1][1].append(line)
    found, lead = [], ""
    for listed, own in groups:
        content = "\n".join(own)
        if not listed:
            lead = content
        found.append(Chunk(f"{lead} {content}" if listed and lead else content, section, "checklist" if listed else "paragraph", page))
    return found


def plain_chunks(text: str, limit: int) -> Iterator[Chunk]:
    section = None
    for block in (b.strip() for b in re.split(r"\n\s*\n", text.strip())):
        if not block:
            continue
        if is_markup_table(block):
            yield Chunk(block, section, "table")
        elif found := list_chunks(block, section, None):
            yield from found
        elif is_aligned_table(block):
            yield Chunk(block, section, "table")
        elif is_definition(block):
            yield Chunk(block, section, "definition")
        elif "\n" not in block and len(block) <= 80 and len(block.split()) <= 10 and block[-1] not in ".!?:;," and title_like(block):
            section = block
        else:
            yield from _prose(block, section, None, limit)


def paged_heading(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 80 and len(s.split()) <= 12 and not s.endswith(":") and (s.isupper() or s.endswith("—") or s.startswith(("§", "Section")))


def section_chunks(lines: list[str], section: str | None, page: int, limit: int) -> Iterator[Chunk]:
    held: list[str] = []

    def flush() -> Iterator[Chunk]:
        if held:
            yield from _prose("\n".join(held), section, page, limit)
            held.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if is_item(line):
            j = i
            while j < len(lines) and is_item(lines[j]):
                j += 1
            lead = [held.pop()] if held and (held[-1].strip().endswith(":") or bare_label(held[-1])) else []
            yield from flush()
            yield from list_chunks("\n".join(lead + lines[i:j]), section, page)
            i = j
            continue
        i += 1
        if not line.strip():
            yield from flush()
        elif "<table" in line.lower() or is_definition(line):
            yield from flush()
            yield Chunk(line, section, "table" if "<table" in line.lower() else "definition", page)
        else:
            held.append(line)
            if tokens("\n".join(held)) >= limit:
                yield from flush()
    yield from flush()


def paged_chunks(pages: list[str], limit: int) -> Iterator[Chunk]:
    for number, page in enumerate(pages, 1):
        section, body = None, []
        for line in (page or "").split("\n") + [None]:
            if line is None or paged_heading(line):
                if any(x.strip() for x in body):
                    yield from section_chunks(body, section, number, limit)
                section, body = line.strip() if line else None, []
            else:
                body.append(line)


def merged(chunks: list[Chunk], limit: int, least: int) -> list[Chunk]:
    """Small paragraphs join the paragraph before (the first one: after) of their section, and
    those right before a list join the list."""
    small = lambda c: c.chunk_type == "paragraph" and tokens(c.content) < least
    mates = lambda a, b: a.chunk_type == b.chunk_type == "paragraph" and a.section == b.section and tokens(a.content + "\n" + b.content) <= limit
    out: list[Chunk] = []
    for c in chunks:
        if out and small(c) and mates(out[-1], c):
            out[-1] = replace(out[-1], content=out[-1].content + "\n" + c.content)
        else:
            out.append(c)
    if len(out) > 1 and small(out[0]) and mates(out[0], out[1]):
        out[:2] = [replace(out[1], content=out[0].content + "\n" + out[1].content)]
    folded: list[Chunk] = []
    for c in out:
        last = folded[-1] if folded else None
        if last is not None and last in out and small(last) and c.chunk_type == "checklist" and c.section == last.section:
            folded[-1] = replace(c, content=last.content + "\n" + c.content)
        else:
            folded.append(c)
    return folded


def chunk_document(text: str | None, pages: list[str] | None = None, limit: int = DEFAULT.chunk_max_tokens, least: int = DEFAULT.chunk_min_tokens) -> list[Chunk]:
    found = list(paged_chunks(pages, limit)) if pages else list(plain_chunks(text, limit)) if text and text.strip() else []
    return merged(found, limit, least)


def chunk_table(df: DataFrame, id_col: str, text_col: str, pages_col: str | None = None, limit: int = DEFAULT.chunk_max_tokens, least: int = DEFAULT.chunk_min_tokens) -> DataFrame:
    """``id_col``, ``chunk_no`` (from 0), content, section, chunk_type, page_number."""
    source = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), (F.col(pages_col) if pages_col else F.lit(None).cast("array<string>")).alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, n, c.content, c.section, c.chunk_type, c.page_number) for k, t, p in zip(batch["k"], batch["t"], batch["p"]) for n, c in enumerate(chunk_document(t, list(p) if p is not None and len(p) else None, limit, least))]
            yield pd.DataFrame(rows, columns=["k", "chunk_no", "content", "section", "chunk_type", "page_number"]).astype({"page_number": "Int64"})

    return source.mapInPandas(run, f"k {source.schema['k'].dataType.simpleString()}, chunk_no int, content string, section string, chunk_type string, page_number int").withColumnRenamed("k", id_col)


def recursive_table(df: DataFrame, id_col: str, text_col: str, limit: int = DEFAULT.chunk_max_tokens) -> DataFrame:
    split = F.udf(lambda t: recursive_chunks(t, limit), "array<string>", useArrow=True)
    return df.select(F.col(id_col), F.posexplode(split(F.col(text_col))).alias("chunk_no", "content"))
