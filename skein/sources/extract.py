"""Text extraction from files, by suffix, as one pass over a ``binaryFile`` table.

Only the standard library is needed; formats that want an outside engine (PDF, OCR) take a
callable, and say so when there is none.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, source_format string, text string, pages array<string>, error string"


def markdown_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


class _Fragments(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


def _html(data: bytes) -> list[str]:
    parser = _Fragments()
    parser.feed(data.decode("utf-8", "replace"))
    return ["\n".join(parser.found)]


def _csv(data: bytes) -> list[str]:
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")))]
    return [markdown_table([r for r in rows if any(r)])]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _docx(data: bytes) -> list[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p"]
    return [p for p in paragraphs if p.strip()]


def _xlsx(data: bytes) -> list[str]:
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
    titles = [s.get("name") or "" for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    out = []
    for title, name in zip(titles, sheets):
        rows = []
        for row in (r for r in ElementTree.fromstring(book.read(name)).iter() if _local(r.tag) == "row"):
            cells = []
            for c in (x for x in row if _local(x.tag) == "c"):
                value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(x.strip() for x in cells):
                rows.append(cells)
        out.append(f"Sheet: {title}\n{markdown_table(rows)}")
    return out


def _pptx(data: bytes) -> list[str]:
    deck = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    out = []
    for i, name in enumerate(slides, 1):
        root = ElementTree.fromstring(deck.read(name))
        in_tables = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter()}
        said = lambda p: "".join(t.text or "" for t in p.iter() if _local(t.tag) == "t")
        lines = [said(p) for p in root.iter() if _local(p.tag) == "p" and id(p) not in in_tables]
        tables = [markdown_table([[said(c) for c in r if _local(c.tag) == "tc"] for r in t if _local(r.tag) == "tr"]) for t in root.iter() if _local(t.tag) == "tbl"]
        out.append("\n".join([f"--- Slide {i} ---", *(x for x in lines if x.strip()), *tables]))
    return out


def _odt(data: bytes) -> list[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))
    tables = [t for t in root.iter() if _local(t.tag) == "table"]
    inside = {id(x) for t in tables for x in t.iter()}
    text = [x for x in ("".join(p.itertext()) for p in root.iter() if _local(p.tag) in ("p", "h") and id(p) not in inside) if x.strip()]
    return text + [markdown_table([["".join(c.itertext()) for c in r if _local(c.tag) == "table-cell"] for r in t.iter() if _local(r.tag) == "table-row"]) for t in tables]


def _rtf(data: bytes) -> list[str]:
    s = data.decode("latin-1")
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m.group(1)).decode("cp1252", "replace"), s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m.group(1)) % 65536), s)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s)
    s = re.sub(r"\\tab\b ?", "\t", s)
    return [re.sub(r"(?<!\\)[{}]", "", re.sub(r"\\[a-z]+-?\d* ?|\\\*", "", s)).strip()]


def _epub(data: bytes) -> list[str]:
    book = zipfile.ZipFile(io.BytesIO(data))
    return [x for x in (_html(book.read(n))[0] for n in book.namelist() if n.lower().endswith((".html", ".xhtml", ".htm"))) if x]


def _plain(data: bytes) -> list[str]:
    return [data.decode("utf-8", "replace")]


READERS: dict[str, Callable[[bytes], list[str]]] = {
    ".txt": _plain, ".md": _plain, ".html": _html, ".htm": _html, ".csv": _csv, ".docx": _docx, ".xlsx": _xlsx, ".pptx": _pptx, ".odt": _odt, ".rtf": _rtf, ".epub": _epub,
}
#: What stands between the pages of a format in the joined text.
JOINTS = {".xlsx": "\n\n", ".pptx": "\n\n", ".epub": "\n\n"}


def extract(name: str, data: bytes, pdf: Callable[[bytes], list[str]] | None = None) -> tuple[str, list[str]]:
    """(text, pages) of a file; ``ValueError`` for a suffix that nobody reads."""
    suffix = "." + name.lower().rpartition(".")[2]
    if suffix == ".pdf":
        if pdf is None:
            raise ValueError("reading PDF needs an engine: pass pdf=")
        pages = pdf(data)
    elif suffix in READERS:
        pages = READERS[suffix](data)
    else:
        raise ValueError(f"unsupported suffix {suffix}")
    return JOINTS.get(suffix, "\n").join(pages), pages


def read_files(spark: SparkSession, path: str, glob: str = "*", pdf: Callable | None = None, ocr: Callable | None = None) -> DataFrame:
    """Every file under ``path``: path, source_format, text, pages, error (null if it was read).

    A PDF with at most 50 characters of text goes to ``ocr`` (bytes -> pages), a page at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"]):
                suffix, text, pages, error = "." + name.lower().rpartition(".")[2], "", [], None
                try:
                    text, pages = extract(name, bytes(data), pdf)
                    if suffix == ".pdf" and len(text.strip()) <= 50 and ocr is not None:
                        pages = ocr(bytes(data))
                        text = "\n".join(pages)
                except Exception as e:  # one broken file must not end the batch
                    error = f"{type(e).__name__}: {e}"
                rows.append((name, suffix[1:], text, pages, error))
            yield pd.DataFrame(rows, columns=["path", "source_format", "text", "pages", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
