"""Queries for the audit, encoding and enrichment of subscribers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from keepwell.catalog import query, views
from keepwell.catalog.views import feedback, subscribers, with_views
from keepwell.operators import drift, features, models
from keepwell.operators.asof import enrich_as_of
from keepwell.operators.quality import data_audit
from keepwell.schemas import CALL_PERIODS, SUBSCRIBERS
from keepwell.session import materialize

_LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, seq DESC) AS n
 FROM feedback) WHERE n = 1)"""
_ENRICHED = f"""SELECT s.*, f.raw_text AS feedback_text, f.feedback_category, f.sentiment, f.complaint_intensity
FROM subscribers s LEFT JOIN {_LATEST} f USING (customer_id)"""
_CATEGORICAL = ("state", "international_plan", "voice_mail_plan", "feedback_category", "sentiment")


def enriched(spark, sf_dir):
    return features.enrich_subscribers(subscribers(spark, sf_dir), feedback(spark, sf_dir), ["created_at", "seq"])


# Each subscriber's row was drawn some days before the newest feedback.
_DRAWN = """drawn AS (SELECT s.*, (SELECT max(created_at) FROM feedback) - to_days(5 + CAST(customer_id AS INTEGER) % 20) AS drawn_at
  FROM subscribers s),
once AS (SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY customer_id, created_at ORDER BY seq DESC) = 1)"""


def enriched_then(spark, sf_dir):
    """Subscribers with the labels that they had when their rows were drawn: what models are trained on."""
    labels = feedback(spark, sf_dir)
    drawn_at = views.newest(labels) - F.make_interval(days=5 + F.col("customer_id").cast("int") % 20)
    return enrich_as_of(subscribers(spark, sf_dir).withColumn("drawn_at", drawn_at), labels, "drawn_at", ["seq"])


@query("enrich_as_of", with_views("subscribers feedback", "SELECT 1").removesuffix("SELECT 1").rstrip() + f""",
{_DRAWN}
SELECT {', '.join(f's.{c}' for c in SUBSCRIBERS.fieldNames() if c not in ('feedback_text', *features.LABEL_COLUMNS))},
       f.raw_text AS feedback_text, f.feedback_category, f.sentiment, f.complaint_intensity
FROM drawn s ASOF LEFT JOIN once f ON s.customer_id = f.customer_id AND s.drawn_at >= f.created_at""")
def _(spark, sf_dir):
    return enriched_then(spark, sf_dir).select(*SUBSCRIBERS.fieldNames())


@query("latest_feedback", with_views("feedback", f"""
SELECT seq, customer_id, feedback_category, sentiment, complaint_intensity, raw_text FROM {_LATEST}"""))
def _(spark, sf_dir):
    newest = features.latest_feedback(feedback(spark, sf_dir), ["created_at", "seq"])
    return newest.select("seq", "customer_id", "feedback_category", "sentiment", "complaint_intensity", "raw_text")


@query("enrich_subscribers", with_views("subscribers feedback", f"SELECT {', '.join(SUBSCRIBERS.fieldNames())} FROM ({_ENRICHED})"))
def _(spark, sf_dir):
    return enriched(spark, sf_dir).select(*SUBSCRIBERS.fieldNames())


_COLUMNS = SUBSCRIBERS.fieldNames()


def _missing(column: str) -> str:
    return f"count(CASE WHEN {column} IS NULL THEN 1 END)"


@query("data_audit", with_views("subscribers feedback", f"""
SELECT unnest(['rows', 'columns', 'missing_total', 'missing_feedback_category', 'missing_sentiment',
               'missing_complaint_intensity']) AS metric,
       unnest([count(*), {len(_COLUMNS)}, {' + '.join(_missing(c) for c in _COLUMNS)}, {_missing('feedback_category')},
               {_missing('sentiment')}, {_missing('complaint_intensity')}]) AS value
FROM ({_ENRICHED})"""))
def _(spark, sf_dir):
    return data_audit(enriched(spark, sf_dir).select(*_COLUMNS))


def _codes(column: str, rows: str = _ENRICHED) -> str:
    return f"""SELECT '{column}' AS feature, value, row_number() OVER (ORDER BY value) - 1 AS code
FROM (SELECT DISTINCT coalesce({column}, 'Missing') AS value FROM ({rows}))"""


@query("category_codes", with_views("subscribers feedback hrefs", "\nUNION ALL\n".join([
    *[_codes(c) for c in _CATEGORICAL],
    _codes("href", "SELECT href FROM hrefs"),
])))
def _(spark, sf_dir):
    rows = features.category_codes(enriched(spark, sf_dir), _CATEGORICAL)
    hrefs = views.links(spark, sf_dir).select(F.regexp_extract("url", r"^https://[^/]+/[^/]+(/.*)\?ref=", 1).alias("href"))
    return rows.unionByName(features.category_codes(hrefs, ["href"]))


_FEATURES = [c for c in _COLUMNS if c not in ("customer_id", "feedback_text", "churn")]


def _feature(column: str) -> str:
    if column not in _CATEGORICAL:
        return f"coalesce({column}, 0) AS {column}"
    return f"(SELECT code FROM ({_codes(column, 'SELECT * FROM enriched')}) c WHERE c.value = coalesce(e.{column}, 'Missing')) AS {column}"


@query("feature_matrix", with_views("subscribers feedback", "SELECT 1").removesuffix("SELECT 1").rstrip() + f""",
enriched AS ({_ENRICHED})
SELECT customer_id, {', '.join(_feature(c) for c in _FEATURES)}, churn AS label FROM enriched e""")
def _(spark, sf_dir):
    return features.feature_matrix(enriched(spark, sf_dir).select(*_COLUMNS), keep=["customer_id"])


# The same codes from the stages that models are trained with, fitted on the same rows.
@query("fitted_features", with_views("subscribers feedback", "SELECT 1").removesuffix("SELECT 1").rstrip() + f""",
enriched AS ({_ENRICHED})
SELECT customer_id, {', '.join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATURES)}
FROM (SELECT customer_id, {', '.join(_feature(c) for c in _FEATURES)} FROM enriched e)""")
def _(spark, sf_dir):
    rows = enriched(spark, sf_dir).select(*_COLUMNS)
    prepared = models.preprocessing(rows)
    vector = vector_to_array("features")
    parts = [vector[i].alias(name) for i, name in enumerate(prepared.names)]
    return models.prepare_rows(prepared, rows).select("customer_id", *parts)


_HALF = "DATE '2024-01-15'"


@query("drift_by_day", f"""
SELECT feature, count(CASE WHEN day < {_HALF} THEN value END) AS n_before, count(CASE WHEN day >= {_HALF} THEN value END) AS n_after,
       count(CASE WHEN day < {_HALF} AND value IS NULL THEN 1 END) AS missing_before,
       count(CASE WHEN day >= {_HALF} AND value IS NULL THEN 1 END) AS missing_after, true AS close
FROM (SELECT CAST(ts AS DATE) AS day, unnest(['hour', 'k', 'odd']) AS feature,
             unnest([hour(ts), k, CASE WHEN k % 2 = 1 THEN k + event_id % 500 END]) AS value
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
GROUP BY feature""")
def _(spark, sf_dir):
    """Sketches per day, stored, then two spans of days against each other; the distance is held against the exact one."""
    events = views.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    names = ["hour", "k", "odd"]
    odd = F.when(F.col("k") % 2 == 1, F.col("k") + F.col("event_id") % 500)
    rows = events.select(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "k", odd.alias("odd"))
    sketches = materialize(drift.daily_sketches(rows, F.col("day"), names), "sketches")
    before = F.col("day") < F.lit("2024-01-15").cast("date")
    found = drift.drift_between(sketches, before, ~before)
    values = rows.select(before.alias("before"), F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names])))
    counts = values.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count_if("before").alias("b"), F.count_if(~F.col("before")).alias("a"))
    so_far = Window.partitionBy("feature").orderBy("value")
    every = Window.partitionBy("feature")
    gap = F.abs(F.sum("b").over(so_far) / F.sum("b").over(every) - F.sum("a").over(so_far) / F.sum("a").over(every))
    exact = counts.select("feature", gap.alias("gap")).groupBy("feature").agg(F.max("gap").alias("exact"))
    close = F.abs(F.col("distance") - F.col("exact")) <= 0.05
    kept = ["feature", "n_before", "n_after", "missing_before", "missing_after"]
    return found.join(exact, "feature").select(*kept, close.alias("close"))


@query("class_weight", with_views("subscribers", """
SELECT positives, negatives, CASE WHEN positives > 0 THEN negatives / positives ELSE 1.0::DOUBLE END AS scale_pos_weight
FROM (SELECT count(CASE WHEN churn = 1 THEN 1 END) AS positives, count(CASE WHEN churn = 0 THEN 1 END) AS negatives
      FROM subscribers)"""))
def _(spark, sf_dir):
    return features.class_weight(subscribers(spark, sf_dir))


@query("stratified_folds", with_views("subscribers", """
SELECT customer_id, churn,
       CAST((row_number() OVER (PARTITION BY churn ORDER BY md5(customer_id), customer_id) - 1) % 3 AS INTEGER) AS fold
FROM subscribers"""))
def _(spark, sf_dir):
    rows = subscribers(spark, sf_dir).select("customer_id", "churn")
    return features.stratified_folds(rows, "churn", "customer_id")


def _total(kind: str) -> str:
    return " + ".join(f"coalesce(CAST(total_{p}_{kind} AS DOUBLE), 0)" for p in CALL_PERIODS)


@query("usage_features", with_views("subscribers", f"""
SELECT customer_id, total_minutes, total_calls, round_even(total_charge, 2) AS total_charge,
       round_even(total_minutes / nullif(total_calls, 0), 6) AS minutes_per_call,
       round_even(total_charge / nullif(total_minutes, 0), 6) AS charge_per_minute,
       round_even(total_minutes / nullif(account_length, 0), 6) AS usage_intensity
FROM (SELECT *, {_total('minutes')} AS total_minutes, {_total('calls')} AS total_calls, {_total('charge')} AS total_charge
      FROM subscribers)"""))
def _(spark, sf_dir):
    rows = features.usage_features(subscribers(spark, sf_dir))
    ratios = ("minutes_per_call", "charge_per_minute", "usage_intensity")
    return rows.select(
        "customer_id", "total_minutes", "total_calls", F.bround("total_charge", 2).alias("total_charge"),
        *[F.bround(c, 6).alias(c) for c in ratios],
    )
