"""Risk expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_THRESHOLD = 0.40


def at_risk(probability: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return probability >= F.lit(threshold)


def risk_level(probability: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(at_risk(probability, threshold), F.lit("High")).otherwise(F.lit("Low"))


def risk_level_with_intent(probability: Column, category: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """A customer who says they will leave is at high risk whatever the model says."""
    leaving = F.coalesce(category == "churn_intent", F.lit(False))
    return F.when(at_risk(probability, threshold) | leaving, F.lit("High")).otherwise(F.lit("Low"))
