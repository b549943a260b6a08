"""Risk and dashboard queries over fixed probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.catalog import query
from keepwell.catalog.features import _ENRICHED, enriched
from keepwell.catalog.views import predictions, subscribers, with_views
from keepwell.operators import scoring
from keepwell.session import scratch_path
from keepwell.sources import readers, writers

_RISK = "CASE WHEN churn_probability >= 0.4 THEN 'High' ELSE 'Low' END"


def _scored(spark, sf_dir):
    return enriched(spark, sf_dir).join(predictions(spark, sf_dir), "customer_id")


@query("risk_levels", with_views("predictions", f"""
SELECT customer_id, churn_probability, {_RISK} AS churn_risk_level, churn_probability >= 0.4 AS action_required
FROM predictions"""))
def _(spark, sf_dir):
    return scoring.with_risk(predictions(spark, sf_dir))


@query("risk_override", with_views("subscribers feedback predictions", f"""
SELECT customer_id, state, feedback_text AS raw_text_analyzed, feedback_category AS extracted_category,
       sentiment AS extracted_sentiment, churn_probability AS ml_churn_probability,
       CASE WHEN churn_probability >= 0.4 OR feedback_category = 'churn_intent' THEN 'High' ELSE 'Low' END
         AS final_churn_risk_level
FROM ({_ENRICHED}) JOIN predictions USING (customer_id)"""))
def _(spark, sf_dir):
    return scoring.checked_predictions(_scored(spark, sf_dir))


@query("churn_dashboard", with_views("predictions", """
SELECT count(*) AS total_customers, CAST(round_even(avg(churn_probability) * 100, 2) AS VARCHAR) || '%'
         AS avg_churn_risk_percentage, count(CASE WHEN churn_probability >= 0.4 THEN 1 END) AS high_risk_customers
FROM predictions"""))
def _(spark, sf_dir):
    return scoring.churn_dashboard(predictions(spark, sf_dir))


_PROFILE = f"""state AS state_region, account_length AS tenure_months, customer_service_calls,
       feedback_category AS top_factor_category, sentiment AS sentiment_flag"""


@query("top_risk_profiles", with_views("subscribers feedback predictions", f"""
SELECT customer_id, churn_probability, {_RISK} AS risk_level, {_PROFILE}
FROM ({_ENRICHED}) JOIN predictions USING (customer_id) ORDER BY churn_probability DESC, customer_id LIMIT 10"""))
def _(spark, sf_dir):
    return scoring.top_risk_profiles(_scored(spark, sf_dir))


@query("customer_profiles", with_views("subscribers feedback predictions", f"""
SELECT customer_id, churn_probability, {_RISK} AS risk_level, {_PROFILE}, CAST(area_code AS VARCHAR) AS area_code,
       feedback_text, complaint_intensity AS complaint_intensity_score,
       CAST(round_even(churn_probability * 100, 2) AS VARCHAR) || '%' AS churn_probability_percentage,
       churn_probability >= 0.4 AS action_required
FROM ({_ENRICHED}) JOIN predictions USING (customer_id)"""))
def _(spark, sf_dir):
    return scoring.customer_profile(_scored(spark, sf_dir))


# Two runs of two model versions, appended to one log.
@query("prediction_log", with_views("predictions", f"""
SELECT customer_id, churn_probability, {_RISK} AS churn_risk_level, churn_probability >= 0.4 AS action_required,
       model_version, true AS dated
FROM (SELECT customer_id, churn_probability, 'v1' AS model_version FROM predictions
      UNION ALL SELECT customer_id, round_even(1 - churn_probability, 4), 'v2' FROM predictions)"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    rows = predictions(spark, sf_dir)
    writers.append_predictions(scoring.prediction_records(rows, "v1"), path)
    reverse = rows.withColumn("churn_probability", F.bround(1 - F.col("churn_probability"), 4))
    writers.append_predictions(scoring.prediction_records(reverse, "v2"), path)
    stored = readers.read_table(spark, path)
    return stored.withColumn("dated", F.col("predicted_at").isNotNull()).drop("predicted_at")


# Small numbers are written with an exponent.
_FIELDS = " || ".join(
    f"',\"{name}\":' || coalesce({value}, 'null')"
    for name, value in {
        "state_region": "to_json(state)",
        "tenure_months": "CAST(account_length AS VARCHAR)",
        "area_code": "to_json(CAST(area_code AS VARCHAR))",
        "customer_service_calls": "CAST(customer_service_calls AS VARCHAR)",
        "feedback_text": "to_json(feedback_text)",
        "top_factor_category": "to_json(feedback_category)",
        "sentiment_flag": "to_json(sentiment)",
        "complaint_intensity_score": "CAST(complaint_intensity AS VARCHAR)",
    }.items()
)
_NUMBER = """CASE WHEN churn_probability > 0 AND churn_probability < 0.001
  THEN CAST(CAST(round(churn_probability * 10000) AS INTEGER) AS VARCHAR) || '.0E-4'
  ELSE CAST(churn_probability AS VARCHAR) END"""


@query("profile_documents", with_views("subscribers feedback predictions", f"""
SELECT customer_id, '{{"search_mode":"individual_profile_lookup","customer_info":{{"customer_id":' || to_json(customer_id) ||
  {_FIELDS} || '}},"predictive_analytics":{{"churn_probability":' || {_NUMBER} || ',"churn_probability_percentage":"' ||
  CAST(round_even(churn_probability * 100, 2) AS VARCHAR) || '%","risk_level":"' || {_RISK} || '","action_required":' ||
  CAST(churn_probability >= 0.4 AS VARCHAR) || '}}}}' AS document
FROM ({_ENRICHED}) JOIN predictions USING (customer_id)"""))
def _(spark, sf_dir):
    return scoring.profile_documents(_scored(spark, sf_dir))


@query("churn_document", with_views("predictions", f"""
SELECT '{{"search_mode":"global_dashboard_summary","total_customers":' || CAST(count(*) AS VARCHAR) ||
  ',"avg_churn_risk_percentage":"' || CAST(round_even(avg(churn_probability) * 100, 2) AS VARCHAR) ||
  '%","high_risk_customers":' || CAST(count(CASE WHEN churn_probability >= 0.4 THEN 1 END) AS VARCHAR) ||
  ',"top_risk_profiles":[' || (SELECT string_agg('{{"customer_id":"' || customer_id || '","churn_probability":' ||
      CAST(churn_probability AS VARCHAR) || ',"risk_level":"' || {_RISK} || '","top_factor_category":"unknown",' ||
      '"state_region":"unknown","tenure_months":0,"customer_service_calls":0,"sentiment_flag":"unknown"}}', ','
      ORDER BY churn_probability DESC, customer_id)
    FROM (SELECT * FROM predictions ORDER BY churn_probability DESC, customer_id LIMIT 10)) || ']}}' AS document
FROM predictions"""))
def _(spark, sf_dir):
    return scoring.churn_document(predictions(spark, sf_dir))


@query("lookup_customers", with_views("subscribers", """
SELECT customer_id, state, churn FROM subscribers WHERE customer_id IN (SELECT CAST(user_id AS VARCHAR) FROM events)"""))
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    requests = events.select(F.concat(F.lit(" '"), F.col("user_id").cast("string"), F.lit("' ")).alias("customer_id"))
    return scoring.lookup_customers(subscribers(spark, sf_dir), requests).select("customer_id", "state", "churn")


@query("high_risk_customers", with_views("subscribers predictions", """
SELECT customer_id, state, account_length, customer_service_calls, churn, churn_probability
FROM subscribers JOIN predictions USING (customer_id) WHERE churn_probability >= 0.4
ORDER BY churn_probability DESC, customer_id"""))
def _(spark, sf_dir):
    records = scoring.prediction_records(predictions(spark, sf_dir), "fixed")
    high = scoring.high_risk_customers(subscribers(spark, sf_dir), records)
    return high.select("customer_id", "state", "account_length", "customer_service_calls", "churn", "churn_probability")
