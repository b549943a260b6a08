"""Column-level shaping: whitelists, defaults, records, payload validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keepwell.functions.text import strip
from keepwell.schemas import FEEDBACK_EXPORT, PAYLOAD, PAYLOAD_DEFAULTS, PAYLOAD_REQUIRED, SUBSCRIBERS, existing

SOURCE = "Facebook"
ANONYMOUS = "Anonymous User"


def project_whitelist(df: DataFrame, allowed: Sequence[str] = tuple(SUBSCRIBERS.fieldNames())) -> DataFrame:
    """The allowed columns that exist, in the allowed order; the label as an integer."""
    out = df.select(*existing(df, allowed))
    return out.withColumn("churn", F.col("churn").cast("int")) if "churn" in out.columns else out


def with_defaults(df: DataFrame, defaults: Mapping[str, Any | Column], fill_nulls: bool = False) -> DataFrame:
    """Add absent columns. Nulls in present ones stay, unless ``fill_nulls``."""
    have = set(df.columns)
    added = {}
    for name, default in defaults.items():
        value = default if isinstance(default, Column) else F.lit(default)
        if name not in have:
            added[name] = value
        elif fill_nulls:
            added[name] = F.coalesce(F.col(name), value)
    return df.withColumns(added) if added else df


def shape_feedback(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as the feedback table takes them: text ids, trimmed names, whole intensities, one source."""
    named = with_defaults(df, {"username": ANONYMOUS})
    typed = {
        "customer_id": F.col("customer_id").cast("string"),
        "username": strip(F.col("username").cast("string")),
        "feedback_category": F.col("feedback_category").cast("string"),
        "sentiment": F.col("sentiment").cast("string"),
        "complaint_intensity": F.col("complaint_intensity").cast("int"),
        "raw_text": F.col("raw_text").cast("string"),
    }
    columns = [typed[name].alias(name) for name in FEEDBACK_EXPORT]
    return named.select(*columns, F.lit(SOURCE).alias("source"), *keep)


def reindex(df: DataFrame, columns: Sequence[str], fill: Any = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``columns``, in that order: absent ones filled, others dropped."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def check_payloads(records: DataFrame) -> DataFrame:
    """Typed records plus ``errors``: what is wrong with a record, null if nothing.

    ``records`` has text columns. A required value must be there and convert;
    an optional one takes its default where it is absent.
    """
    have = set(records.columns)
    values, problems = [], []
    for field in PAYLOAD:
        name = field.name
        raw = F.col(name) if name in have else F.lit(None).cast("string")
        number = not isinstance(field.dataType, T.StringType)
        value = strip(raw).try_cast(field.dataType) if number else raw
        if name in PAYLOAD_REQUIRED:
            problems.append(F.when(raw.isNull(), F.lit(f"{name}: missing")))
        else:
            value = F.when(raw.isNull(), F.lit(PAYLOAD_DEFAULTS[name])).otherwise(value)
        if number:
            problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{name}: not a number")))
        values.append(value.cast(field.dataType).alias(name))
    errors = F.concat_ws("; ", *problems)
    return records.select(*values, F.when(errors != "", errors).alias("errors"))


def validate_payloads(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid typed records, and the others with what is wrong with them."""
    checked = check_payloads(records)
    return checked.filter("errors IS NULL").drop("errors"), checked.filter("errors IS NOT NULL")
