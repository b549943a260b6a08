"""From scored subscribers to dashboards, rankings and prediction records.

A scored frame has ``churn_probability`` as the model gives it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.functions.numbers import percent_text
from keepwell.functions.risk import DEFAULT_THRESHOLD, at_risk, risk_level, risk_level_with_intent
from keepwell.functions.text import clean_id
from keepwell.schemas import existing, first_existing
from keepwell.session import materialize

PROBABILITY = "churn_probability"
# What a document says it is.
SUMMARY, PROFILE = "global_dashboard_summary", "individual_profile_lookup"
STORED_DIGITS = 4
UNKNOWN = "unknown"


def stored(probability: Column) -> Column:
    return F.bround(probability, STORED_DIGITS)


def lookup_customer(table: DataFrame, customer_id: str) -> DataFrame:
    """The rows of one customer. The filter compares the bare column, so that Parquet can skip by it."""
    wanted = customer_id.strip().replace('"', "").replace("'", "")
    return table.filter(F.col("customer_id") == F.lit(wanted))


def lookup_customers(table: DataFrame, requests: DataFrame, column: str = "customer_id") -> DataFrame:
    """The rows of the customers asked for, however the ids were typed."""
    wanted = requests.select(clean_id(F.col(column)).alias("customer_id")).distinct()
    # stored, so that its size is known and a customer with very many rows can be split
    return table.join(materialize(wanted, "wanted"), "customer_id", "left_semi")


def with_risk(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Stored probability, and the level and action that follow from it unrounded."""
    p = F.col(PROBABILITY)
    return scored.withColumns(
        {
            "churn_risk_level": risk_level(p, threshold),
            "action_required": at_risk(p, threshold),
            PROBABILITY: stored(p),
        }
    )


def churn_dashboard(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Customers, mean risk in percent and customers at risk, from unrounded probabilities."""
    p = F.col(PROBABILITY)
    return scored.agg(
        F.count("*").alias("total_customers"),
        percent_text(F.bround(F.avg(p) * 100, 2)).alias("avg_churn_risk_percentage"),
        F.count_if(at_risk(p, threshold)).alias("high_risk_customers"),
    )


def top_risk_profiles(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, n: int = 10) -> DataFrame:
    """The ``n`` customers most likely to leave. Here the level follows from the stored probability."""
    ranked = scored.withColumn(PROBABILITY, stored(F.col(PROBABILITY)))
    top = ranked.orderBy(F.desc(PROBABILITY), "customer_id").limit(n)
    return top.select(
        "customer_id",
        PROBABILITY,
        risk_level(F.col(PROBABILITY), threshold).alias("risk_level"),
        first_existing(scored, ["feedback_category"], UNKNOWN).alias("top_factor_category"),
        first_existing(scored, ["state"], UNKNOWN).alias("state_region"),
        first_existing(scored, ["account_length"], 0).cast("int").alias("tenure_months"),
        first_existing(scored, ["customer_service_calls"], 0).cast("int").alias("customer_service_calls"),
        first_existing(scored, ["sentiment"], UNKNOWN).alias("sentiment_flag"),
    )


def customer_profile(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One line per scored customer with the profile shown for a single one."""
    p = F.col(PROBABILITY)
    return scored.select(
        "customer_id",
        first_existing(scored, ["state"], UNKNOWN).alias("state_region"),
        first_existing(scored, ["account_length"], 0).cast("int").alias("tenure_months"),
        first_existing(scored, ["area_code"], "").cast("string").alias("area_code"),
        first_existing(scored, ["customer_service_calls"], 0).cast("int").alias("customer_service_calls"),
        first_existing(scored, ["feedback_text"], "").alias("feedback_text"),
        first_existing(scored, ["feedback_category"], UNKNOWN).alias("top_factor_category"),
        first_existing(scored, ["sentiment"], UNKNOWN).alias("sentiment_flag"),
        first_existing(scored, ["complaint_intensity"], 0).cast("int").alias("complaint_intensity_score"),
        stored(p).alias(PROBABILITY),
        percent_text(F.bround(p * 100, 2)).alias("churn_probability_percentage"),
        risk_level(p, threshold).alias("risk_level"),
        at_risk(p, threshold).alias("action_required"),
    )


def churn_document(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, n: int = 10) -> DataFrame:
    """The dashboard with its top ``n`` profiles as one JSON text; every key is there, null where nothing is known.

    The scores and what a profile shows are stored first, so that a model runs once.
    """
    shown = ["customer_id", PROBABILITY, "feedback_category", "state", "account_length", "customer_service_calls", "sentiment"]
    scored = materialize(scored.select(*existing(scored, shown)), "scored")
    ordered = F.struct((-F.col(PROBABILITY)).alias("_down"), "customer_id", F.struct("*").alias("profile"))
    profiles = top_risk_profiles(scored, threshold, n).agg(F.sort_array(F.collect_list(ordered)).alias("all"))
    top = profiles.select(F.transform("all", lambda entry: entry["profile"])).scalar()
    document = F.struct(
        F.lit(SUMMARY).alias("search_mode"),
        "total_customers",
        "avg_churn_risk_percentage",
        "high_risk_customers",
        top.alias("top_risk_profiles"),
    )
    return churn_dashboard(scored, threshold).select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def profile_documents(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(customer_id, document): the profile of each customer as JSON text."""
    info = (
        "customer_id", "state_region", "tenure_months", "area_code", "customer_service_calls", "feedback_text",
        "top_factor_category", "sentiment_flag", "complaint_intensity_score",
    )
    analytics = (PROBABILITY, "churn_probability_percentage", "risk_level", "action_required")
    document = F.struct(
        F.lit(PROFILE).alias("search_mode"),
        F.struct(*info).alias("customer_info"),
        F.struct(*analytics).alias("predictive_analytics"),
    )
    return customer_profile(scored, threshold).select("customer_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def checked_predictions(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Stored subscribers with their labels and a risk level that also heeds the intent to leave."""
    p, category = F.col(PROBABILITY), first_existing(scored, ["feedback_category"], UNKNOWN)
    return scored.select(
        "customer_id",
        first_existing(scored, ["state"], UNKNOWN).alias("state"),
        first_existing(scored, ["feedback_text"], "").alias("raw_text_analyzed"),
        category.alias("extracted_category"),
        first_existing(scored, ["sentiment"], UNKNOWN).alias("extracted_sentiment"),
        stored(p).alias("ml_churn_probability"),
        risk_level_with_intent(p, category, threshold).alias("final_churn_risk_level"),
    )


def prediction_records(
    scored: DataFrame,
    model_version: str,
    threshold: float = DEFAULT_THRESHOLD,
    at: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows for the predictions table, and the columns ``keep``."""
    moment = F.current_timestamp() if at is None else at
    return with_risk(scored, threshold).select(
        "customer_id",
        PROBABILITY,
        "churn_risk_level",
        "action_required",
        F.lit(model_version).alias("model_version"),
        moment.alias("predicted_at"),
        *keep,
    )


def high_risk_customers(subscribers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Subscribers predicted at high risk, likeliest first."""
    high = predictions.filter(F.col("churn_risk_level") == "High")
    added = existing(high, [PROBABILITY, "predicted_at"])
    return subscribers.join(high.select("customer_id", *added), "customer_id").orderBy(
        F.desc(PROBABILITY), "customer_id"
    )
