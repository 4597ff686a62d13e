"""From a question to its search plan: parts, each corrected, tagged, expanded and varied."""

from __future__ import annotations

from typing import NamedTuple

from . import concepts as C
from . import dialogue
from . import lexicon as L


class Part(NamedTuple):
    display: str
    text: str
    expanded: str
    entities: list[str]
    intent: str


def intent_of(text: str) -> str:
    return next((name for name, keys in L.INTENTS.items() if any(k in text.lower() for k in keys)), "general")


def plan(normalized: str | None, comparison: tuple[str, str] | None, dictionary: C.Dictionary = C.NONE, speller: dialogue.Speller | None = None, scenarios: list[tuple[str, str]] = (), most: int = 6) -> tuple[list[Part], bool]:
    """Parts of a normalised question, and whether some were left out; a comparison stays one part."""
    if not (normalized or "").strip():
        return [], False
    texts, more = ([normalized], False) if comparison else dialogue.split_questions(normalized, frozenset(dictionary.index), most)
    parts = []
    for shown in texts:
        text = speller.correct(shown) if speller else shown
        found = dialogue.entities(text, dictionary.index)
        wide = dialogue.expand(text, found)
        wide = " ".join([wide, *(c for c in C.scenario_concepts(text, list(scenarios)) if c not in wide)])
        parts.append(Part(shown, text, wide, dialogue.unique_canonicals(found), intent_of(text)))
    return parts, more
