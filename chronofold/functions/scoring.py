"""Scores on an absolute scale from 0 to 1, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
W_RECENCY, W_CONFIDENCE, W_SALIENCE = 0.25, 0.15, 0.10
LEXICAL_HALF = 1.5
PROXIMITY_DAYS, PROXIMITY_FLOOR = 30.0, 0.5
SALIENCE_FLOOR, SALIENCE_CAP, REINFORCE = 0.05, 5.0, 0.25
DAY_SECONDS = 86400.0


def age_days(since: Column, at: Column) -> Column:
    """Days from since to at, never negative."""
    seconds = F.timestamp_diff("SECOND", since, at)
    return F.greatest(F.lit(0.0), seconds / DAY_SECONDS)


def decay(age: Column, half_life: Column | float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def rrf(rank: Column, weight: float = 1.0) -> Column:
    """Share of one list in the fusion; rank counts from 1."""
    return F.lit(weight) / (RRF_K + rank)


def vector_relevance(cosine: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))


def lexical_relevance(bm25: Column, terms: Column) -> Column:
    """BM25 by query term, saturated."""
    per_term = bm25 / terms
    return F.when(per_term > 0, per_term / (per_term + LEXICAL_HALF)).otherwise(0.0)


def evidence(legs: list[tuple[Column, Column, float]]) -> Column:
    """Weighted mean over the active legs: (relevance or null, whether the leg found anything, weight)."""
    top = sum((F.when(on, F.coalesce(x, F.lit(0.0)) * w).otherwise(0.0) for x, on, w in legs), F.lit(0.0))
    under = sum((F.when(on, F.lit(w)).otherwise(0.0) for _, on, w in legs), F.lit(0.0))
    return F.when(under > 0, top / under).otherwise(0.0)


def quality(recency: Column, confidence: Column, salience: Column) -> Column:
    return F.least(F.lit(1.0), (1 + W_RECENCY * recency + W_CONFIDENCE * confidence + W_SALIENCE * salience) / (1 + W_RECENCY + W_CONFIDENCE + W_SALIENCE))


def score(evidence_: Column, quality_: Column) -> Column:
    return F.least(F.lit(1.0), evidence_ * quality_)


def decayed_salience(base: Column, age: Column, half_life: Column | float) -> Column:
    return F.round(F.greatest(F.lit(SALIENCE_FLOOR), base * decay(age, half_life)), 6)


def reinforced(base: Column, salience: Column) -> Column:
    """Salience after a repeat: a fresh memory gains little, a faded one more."""
    faded = 1 - F.least(F.lit(1.0), salience / base)
    return F.least(F.lit(SALIENCE_CAP), base + REINFORCE * (0.1 + 0.9 * faded))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))
