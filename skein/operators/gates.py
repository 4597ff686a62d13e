"""Confidence and the gates in front of an answer, in their fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as T


def confidence(rrf: str, config: EngineConfig = DEFAULT) -> Column:
    best = (config.lexical_weight + config.vector_weight) / (config.rank_constant + 1)
    return F.bround(F.least(F.lit(100.0), F.col(rrf) / best * 100), 1)


def route(value: str, config: EngineConfig = DEFAULT) -> Column:
    return F.when(F.col(value) >= config.answer_at, "answer").when(F.col(value) >= config.partial_at, "partial").otherwise("no_answer")


def recalibrate(value: Column | str, relevance: Column | str, config: EngineConfig = DEFAULT) -> Column:
    c, r = (F.col(x) if isinstance(x, str) else x for x in (value, relevance))
    low, high = config.relevance_low, config.relevance_high
    return c * F.when(r >= high, 1.0).when(r >= low, 0.55 + (r - low) / low * 0.45).otherwise(0.35 + r / low * 0.20)


def answerable(score: str, config: EngineConfig = DEFAULT) -> Column:
    """A missing score abstains."""
    return F.coalesce(F.col(score) >= config.veto_score, F.lit(True))


def evidence_relevance(question: str, phrase: str, excerpt: str) -> Column:
    """The better of the phrase's and the excerpt's relevance; 0 for an empty one."""
    return F.greatest(F.when(F.col(phrase) != "", T.relevance(question, phrase)).otherwise(0.0), F.when(F.col(excerpt) != "", T.relevance(question, excerpt)).otherwise(0.0))


def gated(question: str, phrase: str, relevance: str, value: str, score: str, config: EngineConfig = DEFAULT) -> tuple[Column, Column]:
    """(confidence, routing) after relevance, scope and veto, from columns by name, so that a
    costly relevance is computed once."""
    r = F.col(relevance)
    c = recalibrate(F.col(value), r, config)
    c = F.when(T.out_of_scope(question).isNotNull(), F.least(c, F.lit(config.scope_cap))).otherwise(c)
    c = F.when(answerable(score, config), c).otherwise(F.least(c, F.lit(config.veto_cap)))
    stop = (F.trim(F.coalesce(F.col(phrase), F.lit(""))) == "") | (r < config.relevance_low) | ~answerable(score, config)
    return c, F.when(stop, "no_answer").when(c >= config.answer_at, "answer").when(c >= config.partial_at, "partial").otherwise("no_answer")


def dampened(value: Column | str, generic: Column | str, has_topic: Column | str, shares_word: Column | str, config: EngineConfig = DEFAULT) -> Column:
    """A cap for questions without a subject: generic ones, and those without a known topic none of whose
    content words the evidence has (``shares_word`` is null where there are no content words)."""
    c, g, t, w = (F.col(x) if isinstance(x, str) else x for x in (value, generic, has_topic, shares_word))
    return F.when(g | (~t & ~F.coalesce(w, F.lit(True))), F.least(c, F.lit(config.generic_cap))).otherwise(c)


def package_error(role: Column, client_id: Column, assigned: Column, excerpts: Column) -> Column:
    """Null for a package its reader may see, else why not: ``excerpts`` are structs of ``client_id``,
    ``is_approved`` and ``version``.  The safety net behind the scopes of retrieval."""
    admin = F.coalesce(role.isin("admin", "super_admin"), F.lit(False))
    foreign = F.exists(excerpts, lambda e: ~e["client_id"].eqNullSafe(client_id))
    unassigned = F.exists(excerpts, lambda e: e["client_id"].isNotNull() & ~F.coalesce(F.array_contains(assigned, e["client_id"]), F.lit(False)))
    return (
        F.when(~admin & (role == "client") & foreign, "not the reader's client").when(~admin & ~F.coalesce(role == "client", F.lit(False)) & unassigned, "client not assigned")
        .when(F.exists(excerpts, lambda e: ~F.coalesce(e["is_approved"], F.lit(False))), "not approved").when(F.exists(excerpts, lambda e: F.coalesce(e["version"], F.lit(0)) < 1), "invalid version")
    )
