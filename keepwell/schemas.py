"""Table schemas, and column-optional access to tables that lack some of the columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

_INT, _DOUBLE, _STRING = T.IntegerType(), T.DoubleType(), T.StringType()

CALL_PERIODS = ("day", "eve", "night", "intl")


def _usage_fields() -> list[T.StructField]:
    kinds = (("minutes", _DOUBLE), ("calls", _INT), ("charge", _DOUBLE))
    return [T.StructField(f"total_{period}_{kind}", dtype) for period in CALL_PERIODS for kind, dtype in kinds]


SUBSCRIBERS = T.StructType(
    [
        T.StructField("customer_id", _STRING),
        T.StructField("state", _STRING),
        T.StructField("account_length", _INT),
        T.StructField("area_code", _INT),
        T.StructField("international_plan", _STRING),
        T.StructField("voice_mail_plan", _STRING),
        T.StructField("number_vmail_messages", _INT),
        *_usage_fields(),
        T.StructField("customer_service_calls", _INT),
        T.StructField("churn", _INT),
        T.StructField("feedback_text", _STRING),
        T.StructField("feedback_category", _STRING),
        T.StructField("sentiment", _STRING),
        T.StructField("complaint_intensity", _INT),
    ]
)

COMMENTS = T.StructType(
    [
        T.StructField("customer_id", _STRING),
        T.StructField("post_url", _STRING),
        T.StructField("username", _STRING),
        T.StructField("text", _STRING),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("associated_post_date", _STRING),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("customer_id", _STRING),
        T.StructField("username", _STRING),
        T.StructField("feedback_category", _STRING),
        T.StructField("sentiment", _STRING),
        T.StructField("complaint_intensity", _INT),
        T.StructField("raw_text", _STRING),
        T.StructField("source", _STRING),
        T.StructField("created_at", T.TimestampType()),
    ]
)
FEEDBACK_KEY = ["customer_id", "raw_text"]
FEEDBACK_EXPORT = FEEDBACK.fieldNames()[:6]

PREDICTIONS = T.StructType(
    [
        T.StructField("customer_id", _STRING),
        T.StructField("churn_probability", _DOUBLE),
        T.StructField("churn_risk_level", _STRING),
        T.StructField("action_required", T.BooleanType()),
        T.StructField("model_version", _STRING),
        T.StructField("predicted_at", T.TimestampType()),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("snapshot_date", T.DateType()),
        T.StructField("score", _INT),
        T.StructField("volume", T.LongType()),
        T.StructField("positive", T.LongType()),
        T.StructField("neutral", T.LongType()),
        T.StructField("negative", T.LongType()),
    ]
)

# A single record to score: the subscriber columns up to the service calls are required.
PAYLOAD_REQUIRED = SUBSCRIBERS.fieldNames()[: SUBSCRIBERS.fieldNames().index("churn")]
PAYLOAD_DEFAULTS: Mapping[str, Any] = {"feedback_text": "", "complaint_intensity": 0}
PAYLOAD = T.StructType([SUBSCRIBERS[name] for name in [*PAYLOAD_REQUIRED, *PAYLOAD_DEFAULTS]])


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the order asked for."""
    have = set(df.columns)
    return [name for name in columns if name in have]


def first_existing(df: DataFrame, columns: Sequence[str], default: Any) -> Column:
    """The first of ``columns`` that ``df`` has; the default only where it has none of them."""
    found = existing(df, columns)
    return F.col(found[0]) if found else F.lit(default)


def conform(df: DataFrame, schema: T.StructType, fills: Mapping[str, Any] | None = None) -> DataFrame:
    """Exactly the columns of ``schema``: cast where present, filled where absent."""
    fills = fills or {}
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(fills.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
