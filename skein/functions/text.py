"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import DEFAULT
from . import lexicon as L


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trim all white space, not just spaces."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def content_hash(x: Column | str) -> Column:
    return F.sha2(F.lower(strip(x)), 256)


def words(x: Column | str) -> Column:
    """Non-empty runs of anything but white space."""
    return F.filter(F.split(_c(x), r"\s+"), lambda w: w != "")


def token_count(x: Column | str) -> Column:
    return F.floor(F.size(words(x)) * F.lit(DEFAULT.tokens_per_word)).cast("int")


def plain_tokens(x: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda w: w != "")


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(strip(x), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def normalize(x: Column | str) -> Column:
    """Composed characters, case, quotes, dashes, contractions, repeated marks and words, and spacing of marks.

    The contractions are looked up word by word in one pass, not one after the other.
    """
    s = F.lower(F.translate(_composed(F.coalesce(_c(x), F.lit(""))), "‘’“”–—", "''\"\"--"))
    long = F.create_map(*[F.lit(w) for pair in L.CONTRACTIONS.items() for w in pair])
    # words with their apostrophes, and what stands between them, by turns
    parts = F.regexp_extract_all(s, F.lit(r"(?U)([\w]+(?:'\w+)*|[^\w]+)"), F.lit(1))
    s = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(long, w), w)), "")
    for pattern, to in _REPEATS:
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


#: Repeated and misplaced marks (fixed values: their order matters).
_REPEATS = ((r"(?U)\s+", " "), (r"\?{2,}", "?"), (r"!{2,}", "!"), (r"\.{2,}", "."), (r",{2,}", ","), (r"(?U)\b(\w+)(\s+\1\b)+", "$1"), (r"\s+([?!.,;])", "$1"), (r"(?U)([?!.,;])(\w)", "$1 $2"))


def clean_for_search(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"(?U)[^\w\s%$.\-']+", " "), r"(?U)\s+", " "))


def prefixes(x: Column | str) -> Column:
    """Search prefixes of a question; an empty array matches nothing."""
    return F.array_distinct(plain_tokens(x))


def stems(term: Column | str) -> Column:
    """The term and its light stems, distinct."""
    t = _c(term)
    variants = [F.array(t)]
    for suffix, endings in L.STEM_SUFFIXES:
        root = F.left(t, F.length(t) - F.lit(len(suffix)))
        variants.append(F.when((F.length(t) > 3) & t.endswith(suffix) & (F.length(t) > len(suffix) + 2), F.array(*[F.concat(root, F.lit(e)) for e in endings])).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*variants)))


def content_terms(x: Column | str) -> Column:
    """Terms of a question that carry its subject."""
    stop = F.array(*[F.lit(w) for w in sorted(set(L.QUESTION_STARTERS) | set(L.RELEVANCE_STOP))])
    tokens = F.split(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z']+")
    return F.array_distinct(F.filter(tokens, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def relevance(question: Column | str, text: Column | str) -> Column:
    """Share of a question's terms found (by stem, as substrings) in a text; 1 without terms."""
    terms, hay = content_terms(question), F.lower(F.coalesce(_c(text), F.lit("")))
    hit = F.filter(terms, lambda t: F.exists(stems(t), lambda s: F.contains(hay, s)))
    return F.when(F.size(terms) == 0, F.lit(1.0)).when(hay == "", F.lit(0.0)).otherwise(F.size(hit) / F.size(terms))


def intent(x: Column | str) -> Column:
    s = F.lower(_c(x))
    chain = None
    for name, keys in L.INTENTS.items():
        found = reduce(lambda a, b: a | b, [F.contains(s, F.lit(k)) for k in keys])
        chain = F.when(found, name) if chain is None else chain.when(found, name)
    return chain.otherwise("general")


def out_of_scope(x: Column | str) -> Column:
    q = F.coalesce(_c(x), F.lit(""))
    return F.when(q.rlike(L.PERSONAL_DATA), "personal_data").when(q.rlike(L.FRAUD_VERB) & q.rlike(L.FRAUD_TARGET), "fraud_intent")


#: Patterns of comparison questions, in order (fixed values).
_COMPARISONS = [
    r"^(?:what(?:'s| is| are)?\s+the\s+)?difference\s+between\s+(.+?)\s+and\s+(.+)$",
    r"^what\s+is\s+different\s+between\s+(.+?)\s+and\s+(.+)$",
    r"^compare\s+(.+?)\s+(?:and|with|to|vs\.?|versus)\s+(.+)$",
    r"^how\s+(?:is|are)\s+(.+?)\s+(?:different\s+from|different\s+than|compared\s+to)\s+(.+)$",
    r"^how\s+(?:is|are)\s+(.+?)\s+and\s+(.+?)\s+different$",
    r"^(.+?)\s+(?:vs\.?|versus)\s+(.+)$",
    r"^(.+?)\s+or\s+(.+?)\s+which\s+(?:is|one\s+is)\s+(?:better|best|more\s+suitable|right\s+for\s+me)$",
]


def comparison(x: Column | str) -> Column:
    """struct<left, right> of a comparison question, null for any other."""
    q = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"^[ ?!.,;]+|[ ?!.,;]+$", "")
    tidy = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    options = []
    for p in _COMPARISONS:
        left, right = tidy(F.regexp_extract(q, "(?i)" + p, 1)), tidy(F.regexp_extract(q, "(?i)" + p, 2))
        fit = q.rlike("(?i)" + p) & (left != "") & (right != "") & (left != right) & (F.greatest(F.size(words(left)), F.size(words(right))) <= 6)
        options.append(F.when(fit, F.struct(left.alias("left"), right.alias("right"))))
    return F.coalesce(*options)


def truncate(x: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, cut at a space in the second half, with an ellipsis."""
    s = _c(x)
    head = F.substring(s, 1, limit - 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # index of the last space, from 0
    cut = F.when((F.instr(head, " ") > 0) & (space > limit // 2), F.left(head, space)).otherwise(head)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(cut, F.lit("…")))


def starts_cleanly(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(r"^(?U)\s*[\p{Lu}\d\"'*\-•|]")


def is_fragment(x: Column | str) -> Column:
    """Begins inside a word, or is a generated footer."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)^\s+", "").rlike(r"^(?:[a-z]|\(\s*generated)")


def is_heading_line(x: Column | str) -> Column:
    """Section heading in paged text: short and upper-case, or with a section mark."""
    s = strip(x)
    return (s != "") & (F.length(s) <= 80) & (F.size(words(s)) <= 12) & ~s.endswith(":") & (((F.upper(s) == s) & (F.lower(s) != s)) | s.endswith("—") | s.startswith("§") | s.startswith("Section"))


def is_short_heading(x: Column | str) -> Column:
    """A short line that no sentence mark ends."""
    s = strip(x)
    return (s != "") & ~s.rlike("[.!?]$") & (F.length(s) <= 80)


def is_list_item(x: Column | str) -> Column:
    return _c(x).rlike(r"^(?:[-*]\s|\d+[.)]\s)")


def is_question(x: Column | str) -> Column:
    s = strip(x)
    opener = F.lower(F.regexp_extract(s, r"^([^ ?]*)", 1)).isin("what how why when where who whom which whose is are do does did can could will would should may might".split())
    return (s != "") & (s.endswith("?") | (~s.rlike("[.!]$") & opener))


def has_markdown_table(x: Column | str) -> Column:
    """Two lines or more that begin with a pipe, or a table element."""
    return (F.size(F.filter(F.split(_c(x), "\n"), lambda s: F.startswith(F.trim(s), F.lit("|")))) >= 2) | F.contains(F.lower(_c(x)), F.lit("<table"))


def render_markdown_table(rows: Column | str) -> Column:
    """Rows of cells (array<array<string>>) as a table padded to the widest row."""
    r = _c(rows)
    width = F.array_max(F.transform(r, lambda x: F.size(x)))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.concat(x, F.array_repeat(F.lit(""), (width - F.size(x)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width.cast("int")), " | "), F.lit(" |"))
    lines = F.transform(r, line)
    return F.when(F.size(r) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


def guess_title(x: Column | str) -> Column:
    """The first of the first five filled lines that is short and not all lower-case."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n"), lambda s: strip(s)), lambda s: s != ""), 1, 5)
    fit = F.filter(lines, lambda s: (F.size(F.split(s, r"(?U)\s+")) <= 12) & ~((F.lower(s) == s) & (F.upper(s) != s)))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.substring(F.try_element_at(lines, F.lit(1)), 1, 80))


def guess_doc_type(x: Column | str) -> Column:
    head = F.substring(F.lower(F.coalesce(_c(x), F.lit(""))), 1, 2000)
    chain = None
    for key, kind in L.DOC_TYPE_KEYWORDS:
        chain = F.when(F.contains(head, F.lit(key)), kind) if chain is None else chain.when(F.contains(head, F.lit(key)), kind)
    return chain.otherwise("policy")


def repair_bullets(x: Column | str) -> Column:
    """Misread bullets at line starts become ``- ``."""
    return F.regexp_replace(_c(x), r"(?dmU)^[ \t]*[e•·o©][ \t]+(?=\S)", "- ")


def is_noise_line(x: Column | str) -> Column:
    return strip(x).rlike(r"^[LJ|_—–\-]{1,2}$")


def collapse_doubled(x: Column | str) -> Column:
    """A line that is one text twice becomes that text, from eight characters on."""
    s = strip(x)
    half = (F.length(s) / 2).cast("int")
    return F.when((F.length(s) % 2 == 0) & (half >= 8) & (F.left(s, half) == F.right(s, half)), F.left(s, half)).otherwise(_c(x))


def join_wrapped_lines(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?<=[^\s.!?])\n(?=[a-z])", " ")


def is_complex(x: Column | str) -> Column:
    """Comparison or causal wording, several questions in one, or more than six content words."""
    q = F.concat(F.lit(" "), F.lower(F.trim(_c(x))), F.lit(" "))
    marked = reduce(lambda a, b: a | b, [F.contains(q, F.lit(m)) for m in L.COMPLEX_MARKERS])
    skipped = F.array(*[F.lit(w) for w in sorted({*L.QUESTION_STARTERS, *L.RELEVANCE_STOP, *L.COMPLEX_MARKERS})])
    content = F.filter(F.regexp_extract_all(q, F.lit("([a-z']+)"), F.lit(1)), lambda w: ~F.array_contains(skipped, w))
    return marked | (F.length(_c(x)) - F.length(F.replace(_c(x), F.lit("?"), F.lit(""))) > 1) | F.contains(_c(x), F.lit(";")) | (F.size(content) > 6)


def grounded(answer: Column | str, evidence: Column | str, soft: list[str] | None = None) -> Column:
    """Whether each sentence has most of its terms, and all its numbers, in the evidence."""
    blob = F.lower(F.coalesce(_c(evidence), F.lit("")))
    number = r"(\d[\d,]*(?:\.\d+)?)"
    bare = lambda s: F.transform(F.regexp_extract_all(s, F.lit(number), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))
    known = bare(blob)
    skip = F.array(*[F.lit(w) for w in sorted(set(L.QUESTION_STARTERS) | set(L.RELEVANCE_STOP) | set(soft or []))])

    def one(s: Column) -> Column:
        terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)*)"), F.lit(1)), lambda w: (F.length(w) > 1) & ~F.array_contains(skip, w)))
        hits = F.size(F.filter(terms, lambda w: F.contains(blob, w)))
        return (F.size(terms) == 0) | ((hits / F.greatest(F.size(terms), F.lit(1)) >= DEFAULT.grounding_overlap) & (F.size(F.array_except(bare(s), known)) == 0))

    return F.forall(sentences(F.regexp_replace(_c(answer), r"\s*\[\d+\]", "")), one)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), for use inside Arrow UDFs."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for ch in a:
        diagonal = 0
        for j, other in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))
