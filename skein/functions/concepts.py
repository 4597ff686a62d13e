"""A dictionary of terms and what questions owe to it: concepts, synonyms, term groups, relevance.

The dictionary is a parameter (canonical -> type and aliases); everything here is a plain function,
wrapped as an Arrow UDF by :func:`arrow` where a table is concerned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F

from . import lexicon as L

_SKIPPED = frozenset(L.QUESTION_STARTERS) | frozenset(L.RELEVANCE_STOP)
#: Words that mean the same in a question and an answer (fixed values).
SYNONYMS = {"job": ["employment", "employed", "employer", "employers"], "verify": ["verification", "verified", "verifying"]}
#: Verbs that may stand before the name of a concept (fixed values).
REQUEST_VERBS = "define explain describe tell list show give provide summarise summarize what whats".split()


def arrow(function: Callable, returns: str):
    """``function`` of one row's values as an Arrow UDF."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns)])

    return run


def stems(term: str) -> set[str]:
    """The term and its light stems."""
    found = {term}
    if len(term) > 3:
        found.update(term[: -len(end)] + new for end, news in L.STEM_SUFFIXES if term.endswith(end) and len(term) > len(end) + 2 for new in news)
    return found


class Dictionary:
    """Aliases (canonicals included) -> (canonical, type); a later canonical wins a shared alias."""

    def __init__(self, terms: dict[str, tuple[str, Iterable[str]]]):
        self.index = {alias: (canonical, kind) for canonical, (kind, aliases) in terms.items() for alias in {canonical, *aliases}}
        self.phrases = [a for a in self.index if " " in a]

    def canonical_of(self, alias: str) -> str:
        return self.index[alias][0] if alias in self.index else alias

    def type_of(self, alias: str) -> str | None:
        return self.index[alias][1] if alias in self.index else None

    def names_concept(self, text: str | None) -> bool:
        """An alias as a token, or one of several words anywhere."""
        low = (text or "").lower()
        return any(t in self.index for t in re.findall(r"[a-z0-9']+", low)) or any(p in low for p in self.phrases)

    def topics(self, text: str, keywords: dict[str, str] | None = None) -> list[str]:
        """Canonicals and keyword topics mentioned anywhere in a text, sorted."""
        found = {canonical for alias, (canonical, _) in self.index.items() if alias in text}
        return sorted(found | {topic for word, topic in (keywords or {}).items() if word in text.lower()})


NONE = Dictionary({})


def synonyms_of(term: str) -> set[str]:
    """Both ways: of a key its group, of a member its key and group."""
    if term in SYNONYMS:
        return set(SYNONYMS[term])
    return next(({key, *group} for key, group in SYNONYMS.items() if term in group), set())


def known_concept(text: str | None, concepts: frozenset[str] | set[str]) -> bool:
    """Whether a request, its leading verbs aside, is a defined concept or its plural."""
    words = [w for w in re.split(r"[^a-z0-9'/-]+", (text or "").lower()) if w]
    while words and words[0] in REQUEST_VERBS:
        del words[0]
    name = " ".join(words)
    return bool(name) and (name in concepts or (name.endswith("s") and name[:-1] in concepts))


def scenario_concepts(text: str, patterns: list[tuple[str, str]]) -> list[str]:
    """Concepts whose pattern a described situation matches, each once, in order."""
    return list(dict.fromkeys(concept for pattern, concept in patterns if re.search(pattern, text.lower())))


def term_groups(question: str | None, dictionary: Dictionary = NONE) -> list[list[str]]:
    """A question's content terms, each with the words of its canonical form: one concept a group.

    Terms below three letters count only if the dictionary knows them.
    """
    groups = []
    for t in re.split(r"[^a-z']+", (question or "").lower()):
        canonical = dictionary.canonical_of(t)
        if t not in _SKIPPED and (len(t) > 2 or canonical != t):
            own = {w for w in canonical.split() if len(w) > 2 and w not in L.RELEVANCE_STOP} if canonical != t else set()
            groups.append([t, *sorted(own - {t})])
    return groups


def present(term: str, low_text: str) -> bool:
    return any(c in low_text for c in stems(term) | synonyms_of(term))


def matched(groups: list[list[str]], text: str) -> int:
    low = text.lower()
    return sum(any(present(t, low) for t in g) for g in groups)


def supported(groups: list[list[str]], vocabulary: set[str] | frozenset[str]) -> list[list[str]]:
    """Groups that the corpus knows; all of them if it knows none or there is no vocabulary."""
    known = [g for g in groups if any(not vocabulary.isdisjoint(stems(t)) for t in g)] if vocabulary else groups
    return known or groups


def relevance(question: str | None, text: str | None, dictionary: Dictionary = NONE, vocabulary: frozenset[str] = frozenset()) -> float:
    """Share of a question's concepts in a text; 1 without concepts, else 0 without text."""
    groups = supported(term_groups(question, dictionary), vocabulary)
    if not groups:
        return 1.0
    return matched(groups, text) / len(groups) if text else 0.0


def vocabulary_of(words: Iterable[str]) -> set[str]:
    """Words of three letters or more, with their stems."""
    own = {w.strip().lower() for w in words if w}
    return {c for w in own if len(w) > 2 and re.fullmatch(r"[a-z][a-z'-]*", w) for c in {w, *(x for x in stems(w) if len(x) > 2)}}


#: Words of a question without a subject of its own (fixed values).
SUBJECTLESS = (
    "this that it its these those them they you your me my we us ours work works working workings happen happens happened next then afterwards mean means meant meaning explain explained explanation "
    "actually exactly simply basically more further else anything something thing things about info information details detail relevant rules rule go goes going fine okay ok"
).split()


def content_words(question: str, common: Iterable[str] = L.RELEVANCE_STOP) -> list[str]:
    skipped = {*L.QUESTION_STARTERS, *common}
    return [w for w in re.split(r"[^a-z']+", question.lower()) if w and w not in skipped]


def without_subject(question: str) -> bool:
    """One or two content words, all of them generic."""
    words = content_words(question)
    return 0 < len(words) < 3 and set(words) <= set(SUBJECTLESS)


def shared_qualifier(left: str, right: str, dictionary: Dictionary, kind: str) -> tuple[str, str]:
    """A bare name of ``kind`` takes the words that follow such a name in the other operand."""
    a, b = left.split(), right.split()
    named = lambda words: bool(words) and dictionary.type_of(words[0]) == kind
    if named(a) and named(b) and (len(a) == 1) != (len(b) == 1):
        return (" ".join(a + b[1:]), right) if len(a) == 1 else (left, " ".join(b + a[1:]))
    return left, right


def flat(text: str | None) -> str:
    """Lower case, marks as single spaces, with a space at either end."""
    return f" {re.sub('[^a-z0-9]+', ' ', (text or '').lower()).strip()} "


def missing_canonicals(text: str, canonicals: Iterable[str], most: int = 20) -> list[str]:
    """Of the longest ``most`` canonicals those that neither the text nor a longer one has, whatever the marks."""
    found, seen = [], flat(text)
    for c in sorted({c for c in canonicals if c}, key=lambda c: (-len(c), c))[:most]:
        if flat(c) not in seen and flat(c) not in map(flat, found):
            found.append(c)
    return found


def follow_up_suggestions(topics: Iterable[str], curated: dict[str, list[str]], generic: list[str], most: int = 3) -> list[str]:
    """Curated questions of the topics, in the order of ``curated`` and topic by topic until there are
    enough; the generic ones if there are none."""
    found: list[str] = []
    for topic, questions in curated.items():
        if topic in topics and len(found) < most:
            found += [q for q in questions if q not in found]
    return found or list(dict.fromkeys(generic))
