"""What a question asks for: which legs of a search take part, whose turns answer it, whether it names a chain of relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGS = ("vector", "lexical", "graph", "temporal")
# Legs that take no part, by intent; all others keep the weight they are given.
SILENT = {"lookup": {"graph", "temporal"}, "temporal": {"graph"}, "relational": {"temporal"}, "open": set()}
# Phrases of a question about what the assistant said.
ASSISTANT_PHRASES = (
    "you suggested", "you recommended", "you mentioned", "you told me", "you provided", "you wrote", "you created", "did you say",
    "can you remind me", "remind me what", "remind me which", "remind me who", "remind me how", "remind me of",
)


def leg_weight(intent: Column, leg: str, weight: float = 1.0) -> Column:
    """The weight of a leg for a question of this intent."""
    if leg not in LEGS:
        raise ValueError(f"legs are {LEGS}")
    off = sorted(i for i, legs in SILENT.items() if leg in legs)
    return F.when(intent.isin(off), 0.0).otherwise(float(weight)) if off else F.lit(float(weight))


def routed_role(question: Column) -> Column:
    """assistant if the question is about what the assistant said, else user."""
    asks = question.rlike(r"(?i)\b(?:" + "|".join(ASSISTANT_PHRASES) + r")\b")
    return F.when(asks, "assistant").otherwise("user")


def names_derived(question: Column, terms: list[str]) -> Column:
    """Whether the question holds one of the terms that stand for a chain of relations, be it within a longer word."""
    low = F.lower(question)
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return F.coalesce(out, F.lit(False))
