"""Confidence tiers and the adjustment by search intent, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Intent labels by cluster number, and the label pairs that change confidence.
INTENT_LABELS = (
    "informationnelle", "navigationnelle", "transactionnelle", "commerciale", "divers",
)
INTENT_CONFLICTS = (
    ("transactionnelle", "informationnelle"),
    ("transactionnelle", "divers"),
    ("commerciale", "informationnelle"),
    ("commerciale", "divers"),
    ("informationnelle", "transactionnelle"),
)
INTENT_BONUS = ("transactionnelle", "commerciale", "informationnelle", "navigationnelle")


def confidence_tier(match_type: Column, score: Column) -> Column:
    """``high``, ``medium`` or ``low`` from the unrounded score of a match."""
    high = (
        (match_type == "exact")
        | ((match_type == "cosine") & (score >= 0.70))
        | ((match_type == "fuzzy") & (score >= 85))
    )
    medium = (
        ((match_type == "cosine") & (score >= 0.40))
        | ((match_type == "fuzzy") & (score >= 70))
        | (match_type == "hierarchical_L1")
    )
    return F.when(high, F.lit("high")).when(medium, F.lit("medium")).otherwise(F.lit("low"))


def intent_conflict(source: Column, target: Column) -> Column:
    """True where the intents of a redirect's two ends contradict each other."""
    source, target = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    pair = F.concat(source, F.lit(">"), target)
    return pair.isin([f"{a}>{b}" for a, b in INTENT_CONFLICTS])


def adjusted_confidence(confidence: Column, source: Column, target: Column) -> Column:
    """Conflicting intents force ``low``; equal ones raise a tier; a missing one changes nothing."""
    same = (source == target) & source.isin(list(INTENT_BONUS))
    raised = F.when(confidence == "low", F.lit("medium")).otherwise(F.lit("high"))
    return (
        F.when(intent_conflict(source, target), F.lit("low"))
        .when(same, raised).otherwise(confidence)
    )
