"""Questions: splitting into parts, spelling, entities, expansion and follow-ups.

Order-dependent pieces are plain functions over strings, wrapped as Arrow UDFs by the callers;
the dictionary (alias -> canonical) is a parameter.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import indel_ratio

_STARTERS, _INFO, _VERBS = frozenset(L.QUESTION_STARTERS), frozenset(L.INFO_NOUNS), frozenset(L.INFO_VERBS)
#: Words that may join questions, and those that may begin one without being part of it (fixed values).
_JOINERS = "and|also|plus|or|additionally|as well as|then"
_BOUND = re.compile(rf"(?P<hard>[?!;\n])|(?P<comma>(?<!\d),(?!\d))|(?<=\s)(?P<word>{_JOINERS})(?=\s)")
_LEAD = re.compile(r"^(?:(?:and|also|plus|or|additionally|in addition|then)\s+)+")
_LIMITS = frozenset(("max", "min", "maximum", "minimum"))


class Piece(NamedTuple):
    """What stands between two boundaries, and what the boundary before it is."""

    bound: str  # hard, comma, word; empty at the beginning
    join: str  # how it is put behind what came before
    text: str
    own: str  # the text without connectives before it
    asks: bool  # reads as a question of its own
    limit: bool  # begins with a limit word
    names: bool  # names what is wanted


def _named(words: list[str], text: str, aliases: frozenset[str]) -> bool:
    return not (_INFO | aliases).isdisjoint(words) or any(a in text for a in aliases if " " in a)


def _piece(bound: str, mark: str, text: str, aliases: frozenset[str]) -> Piece:
    own = _LEAD.sub("", text) if bound == "word" else text
    words = own.split()
    asks = bool(words) and (words[0] in _STARTERS or not _VERBS.isdisjoint(words))
    join = {"comma": ", ", "word": f" {mark} "}.get(bound, "")
    return Piece(bound, join, text, own, asks, bool(words) and words[0] in _LIMITS, _named(words, own.lower(), aliases))


def _pieces(text: str, aliases: frozenset[str]) -> list[Piece]:
    """Between boundaries; of several in a row the last counts."""
    found, bound, mark, at = [], "", "", 0
    for m in [*_BOUND.finditer(text), None]:
        part = text[at : m.start() if m else len(text)].strip()
        if part:
            found.append(_piece(bound if found else "", mark, part, aliases))
        if m:
            bound, mark, at = m.lastgroup, m.group(), m.end()
    return found


def self_contained(text: str | None, aliases: frozenset[str] = frozenset()) -> bool:
    """Whether a noun phrase asks for something by itself."""
    low = (text or "").strip().lower()
    words = low.split()
    return bool(words) and (words[0] in _LIMITS or _named(words, low, aliases))


def split_questions(text: str | None, aliases: frozenset[str] = frozenset(), most: int = 6) -> tuple[list[str], bool]:
    """Sub-questions of a normalised question, and whether there were more than ``most``.

    A piece opens a question of its own after a hard boundary, if it asks, or if it and the question
    before it are both complete requests; other pieces go on with the question before.
    """
    questions: list[list[Piece]] = []
    for p in _pieces(text or "", aliases):
        before = questions[-1] if questions else []
        complete = bool(before) and (before[0].limit or any(x.names for x in before)) and (p.limit or p.names)
        if not before or p.bound == "hard" or (p.own and (p.asks or complete)):
            questions.append([p])
        else:
            before.append(p)
    told = ["".join([q[0].own, *(p.join + p.text for p in q[1:])]) for q in questions]
    tidy = dict.fromkeys(_LEAD.sub("", q).strip(" ?!;,") for q in told)
    kept = [q for q in tidy if q and q not in L.NOISE_WORDS]
    return kept[:most], len(kept) > most


class Speller:
    """Repairs misspelt tokens against a vocabulary; words of the corpus are left alone."""

    def __init__(self, vocabulary: list[str], phrases: list[str] = (), corpus: frozenset[str] = frozenset()):
        self.words = sorted({w for w in vocabulary if " " not in w} | {w for p in phrases for w in p.split() if w.isalpha() and len(w) > 3})
        self.known, self.corpus = frozenset(self.words), corpus
        self.partners: dict[str, set[str]] = {}
        for p in phrases:
            for w in p.split():
                self.partners.setdefault(w, set()).update(x for x in p.split() if x != w)
        self.phrases = [p.split() for p in sorted({p for p in phrases if " " in p}, key=lambda p: (-len(p), p))]
        self.exact = {tuple(p) for p in self.phrases}
        self.starters = sorted(L.QUESTION_STARTERS)
        self.seen: dict[tuple[str, frozenset[str]], str] = {}

    def token(self, t: str, near: frozenset[str]) -> str:
        if len(self.seen) > 50_000:
            self.seen.clear()
        if (t, near) not in self.seen:
            self.seen[t, near] = self._token(t, near)
        return self.seen[t, near]

    def _protected(self, t: str) -> bool:
        return not re.fullmatch("[a-z]+", t) or t in self.known or t in self.corpus or (len(t) > 4 and t[-1] == "s" and t[:-1] in self.known) or len(t) < 4

    def _token(self, t: str, near: frozenset[str]) -> str:
        if len(t) == 3:
            best = max(self.starters, key=lambda w: indel_ratio(t, w))
            if indel_ratio(t, best) >= 85:
                return best
        if self._protected(t):
            return t
        if len(t) > 4:
            for i in range(2, len(t) - 1):
                if t[:i] in self.known and t[i:] in self.known:
                    return f"{t[:i]} {t[i:]}"
        ranked = sorted(((-indel_ratio(t, w), w) for w in self.words if abs(len(w) - len(t)) <= len(t)))[:15]
        best, most = t, 80.0 - 1e-9
        for score, w in ranked:
            if abs(len(w) - len(t)) <= max(1, len(t) // 4):
                value = -score + (20 if near & self.partners.get(w, set()) else 0)
                if value > most:
                    best, most = w, value
        return best

    def correct(self, text: str | None) -> str | None:
        if not text:
            return text
        words = text.split()
        return self.phrase_pass(" ".join(self.token(w, frozenset(words[max(0, i - 1) : i] + words[i + 1 : i + 2])) for i, w in enumerate(words)))

    def _repairs(self, window: list[str], phrase: list[str]) -> bool:
        """Whether a window differs from a phrase by misspellings of unprotected words only."""
        changed = [(w, p) for w, p in zip(window, phrase) if w != p]
        return bool(changed) and all(not self._protected(w) and abs(len(w) - len(p)) <= max(1, len(w) // 4) for w, p in changed) and indel_ratio(" ".join(window), " ".join(phrase)) >= 92

    def phrase_pass(self, text: str, passes: int = 3) -> str:
        """Misspelt phrases of several words, the longest first; one repair a pass."""
        words = text.split()
        for _ in range(passes):
            taken: set[int] = set()
            for phrase in self.phrases:
                n = len(phrase)
                for i in range(len(words) - n + 1):
                    if taken.isdisjoint(range(i, i + n)):
                        if tuple(words[i : i + n]) in self.exact:
                            taken.update(range(i, i + n))
                        elif self._repairs(words[i : i + n], phrase):
                            words[i : i + n] = phrase
                            break
                else:
                    continue
                break
            else:
                break
        return " ".join(words)


def entities(text: str, dictionary: dict[str, tuple[str, str]]) -> list[tuple[str, str, str, int, int]]:
    """(canonical, type, matched, start, end): numbers, then the longest aliases first."""
    found = [(kind, kind, m.group(), m.start(), m.end()) for kind, p in (("percentage", r"\d[\d,]*(?:\.\d+)?%"), ("amount", r"\$\s?\d[\d,]*(?:\.\d{1,2})?")) for m in re.finditer(p, text or "")]
    words = [(m.start(), m.end()) for m in re.finditer(r"[\w'-]+", text or "")]
    taken: list[tuple[int, int]] = []
    for n in (3, 2, 1):
        for i in range(len(words) - n + 1):
            a, b = words[i][0], words[i + n - 1][1]
            hit = dictionary.get(text[a:b])
            if hit and all(b <= x or a >= y for x, y in taken):
                found.append((hit[0], hit[1], text[a:b], a, b))
                taken.append((a, b))
    return sorted(found, key=lambda e: (e[3], -e[4]))


def expand(text: str, found: list[tuple[str, str, str, int, int]]) -> str:
    extra = dict.fromkeys(c for c, kind, *_ in found if kind not in ("percentage", "amount") and c not in text)
    return " ".join([text, *extra]).strip()


def variants(text: str, dictionary: dict[str, tuple[str, str]], most: int = 3) -> list[str]:
    base = (text or "").strip()
    if not base:
        return []
    options = [base, expand(base, entities(base, dictionary))]
    m = re.match(r"(?i)^\s*(?:what\s+(?:is|are|was|were)|define|meaning\s+of|what\s+does\s+\S+\s+mean)\s+(.+?)\s*\??\s*$", base)
    if m and m.group(1).strip(" ?"):
        options.append(m.group(1).strip(" ?") + " definition")
    distinct: dict[str, str] = {}
    for o in options:
        distinct.setdefault(o.casefold(), o)
    return list(distinct.values())[:most]


#: Words that make no subject (fixed values).
_NO_SUBJECT = frozenset(
    "what how why when where which who whose is are was were do does did can could will would should may might must the a an of to for and or on in with about there it they them this that these those be being been have has had i you we my your our me us their his her its".split()
)


def subject_of(question: str | None, dictionary: dict[str, tuple[str, str]] | None = None) -> str | None:
    """The first entity of a normalised question's first part, else its first four telling words."""
    parts, _ = split_questions(question)
    if not parts:
        return None
    named = unique_canonicals(entities(parts[0], dictionary or {}))
    words = [w for w in parts[0].split() if w not in _NO_SUBJECT][:4]
    return named[0] if named else " ".join(words) or None


def unique_canonicals(found: list[tuple[str, str, str, int, int]]) -> list[str]:
    return list(dict.fromkeys(c for c, kind, *_ in found if kind not in ("percentage", "amount")))


def follow_up(question: Column | str, subject: Column | str, own_topic: Column | str) -> Column:
    """A follow-up with what refers to the turn before replaced by that turn's subject.

    ``own_topic``: whether the question names a topic of its own.  "The above" and "the same" come
    before pronouns; a short question without any topic gets the subject in front.
    """
    asked, about, own = (F.col(x) if isinstance(x, str) else x for x in (question, subject, own_topic))
    q = F.trim(F.coalesce(asked, F.lit("")))
    low, words = F.lower(q), F.split(q, r"\s+")
    literal = F.regexp_replace(about, r"([\\$])", r"\\$1")
    swapped = lambda pattern: F.when(low.rlike(pattern), F.regexp_replace(q, F.lit(pattern), literal))
    leads = F.lower(words[0]).rlike(r"^(?:what|how|why|when|where|which|who|can|could|will|would|should|is|are|do|does|did)\b")
    bare = leads & (F.size(words) <= 6) & ~F.exists(F.slice(words, 2, 6), lambda w: w.rlike(r"^\p{Lu}")) & ~own
    changed = F.coalesce(swapped(r"\b(?:the above|the same)\b"), swapped(r"\b(?:it|they|them|this|that|these|those)\b"), F.when(bare, F.concat(about, F.lit(" "), q)))
    return F.when((q == "") | about.isNull() | (about == "") | F.contains(low, F.lower(about)), asked).otherwise(F.coalesce(changed, asked))
