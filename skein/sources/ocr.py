"""Repairs of optical character recognition, line by line, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def clean_text(x: Column | str) -> Column:
    """Bullets repaired, noise lines dropped, doubled headings halved, and blank lines removed that only
    separate the items of a list, or a list from the line with a colon before it."""
    lines = F.filter(F.split(T.repair_bullets(x), "\n"), lambda s: ~T.is_noise_line(s))
    lines = F.transform(lines, T.collapse_doubled)
    filled = lambda s: T.strip(s) != ""
    item = lambda s: T.is_list_item(T.strip(s))

    def binds(i: Column) -> Column:
        before = F.try_element_at(F.filter(F.slice(lines, 1, i), filled), F.lit(-1))
        after = F.try_element_at(F.filter(F.slice(lines, i + 1, F.size(lines)), filled), F.lit(1))
        return F.coalesce(item(after) & (item(before) | T.strip(before).endswith(":")), F.lit(False))

    kept = F.filter(F.transform(lines, lambda s, i: F.when(filled(s) | ~binds(i), s)), lambda s: s.isNotNull())
    return F.when(T._c(x) == "", T._c(x)).otherwise(F.array_join(kept, "\n"))


def clean_pages(pages: Column | str) -> Column:
    """Cleaned pages without those that hold nothing then."""
    return F.filter(F.transform(T._c(pages), clean_text), lambda p: T.strip(p) != "")


def needs_ocr(suffix: Column | str, text: Column | str) -> Column:
    """A PDF whose text layer has at most 50 characters."""
    return (F.lower(T._c(suffix)) == ".pdf") & (F.length(T.strip(F.coalesce(T._c(text), F.lit("")))) <= 50)
