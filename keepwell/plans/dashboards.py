"""Dashboards over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from keepwell.functions.risk import DEFAULT_THRESHOLD
from keepwell.operators import scoring
from keepwell.operators.models import ChurnModel, score
from keepwell.operators.reputation import reputation_document
from keepwell.sources.readers import require_rows


def reputation(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    return reputation_document(feedback, as_of)


def churn(
    subscribers: DataFrame, model: ChurnModel, threshold: float = DEFAULT_THRESHOLD, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The summary line and the top profiles of the subscriber table, or of ``limit`` rows of it.

    Both read the same scored frame; the caller persists or unpersists it as needed.
    """
    rows = subscribers if limit is None else subscribers.limit(limit)
    scored = score(model, require_rows(rows, "the subscriber table"))
    return scoring.churn_dashboard(scored, threshold), scoring.top_risk_profiles(scored, threshold)


def profile(
    subscribers: DataFrame, model: ChurnModel, customer_id: str, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """The profile of one customer; no row if there is no such customer."""
    return scoring.customer_profile(score(model, scoring.lookup_customer(subscribers, customer_id)), threshold)
