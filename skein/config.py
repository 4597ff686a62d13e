"""Tunable constants of the engine, in one place and overridable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    lexical_weight: float = 0.3
    vector_weight: float = 0.7
    entity_weight: float = 0.15
    similarity_floor: float = 0.65
    rank_constant: int = 60
    missing_rank: int = 9999
    candidates: int = 100
    rerank_pool: int = 25
    rerank_head: int = 5
    evidence: int = 3
    excerpt_chars: int = 600
    phrase_chars: int = 200
    answer_at: float = 90.0
    partial_at: float = 50.0
    relevance_high: float = 0.70
    relevance_low: float = 0.35
    generic_cap: float = 74.0
    scope_cap: float = 15.0
    veto_cap: float = 20.0
    veto_score: float = -6.5
    fragment_penalty: float = 0.35
    grounding_overlap: float = 0.6
    max_sub_queries: int = 6
    alias_ngram: int = 3
    max_variants: int = 3
    chunk_max_tokens: int = 300
    chunk_min_tokens: int = 50
    tokens_per_word: float = 1.3
    upload_limit_bytes: int = 20 * 1024 * 1024
    requests_per_window: int = 120
    request_window_s: int = 60
    failures_per_window: int = 20
    failure_window_s: int = 900
    lock_s: int = 900
    #: Swappable models: texts -> list of vectors; (questions, contents) -> scores.
    embed: Callable | None = field(default=None, compare=False)
    rerank: Callable | None = field(default=None, compare=False)


DEFAULT = EngineConfig()
