"""Joins as of a time: the newest row of a history that a time of its own allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepwell.operators.features import LABEL_COLUMNS
from keepwell.session import materialize

_MICROS = 1_000_000


def _span(time: Column, seconds: int) -> Column:
    """The number of the stretch of time, ``seconds`` long, that a timestamp is in."""
    return F.floor(F.unix_micros(time) / F.lit(seconds * _MICROS)).cast("bigint")


def as_of_join(
    rows: DataFrame,
    history: DataFrame,
    key: str,
    at: str,
    time: str,
    values: Sequence[str],
    sequence: Sequence[str] = (),
    seconds: int = 86_400,
) -> DataFrame:
    """``rows`` with the columns ``values`` of their key's last history row at or before ``at``, null without any.

    Last means by ``time`` and then ``sequence``. The history of a key is split into stretches of ``seconds``: of stretches
    without rows to look up, only the last history row goes on, found before the shuffle; what a stretch takes over from those
    before it is found among such last rows; and only inside stretches with rows to look up are times put in order. So
    a key with very much history is dealt out over its stretches. Rows without a key or a time find nothing; history
    without a time is never found. Columns of ``rows`` named like ``values`` are replaced.
    """
    kept = [c for c in rows.columns if c not in values]
    asked = rows.select(*kept).withColumn("_row", F.monotonically_increasing_id())
    asked = materialize(asked, "as-of-rows")  # numbers of rows must not change
    looked = asked.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    looked = looked.select(F.col(key).alias("_key"), F.col(at).cast("timestamp").alias("_time"), "_row")
    known = history.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(time).cast("timestamp").alias("_time"),
        F.struct(*[F.col(c) for c in sequence] or [F.lit(0)]).alias("_order"),
        F.struct(*[F.col(c) for c in values]).alias("_values"),
    )
    looked, known = (df.withColumn("_span", _span(F.col("_time"), seconds)) for df in (looked, known))
    asked_spans = looked.select("_key", "_span").distinct()
    last = known.groupBy("_key", "_span").agg(F.max_by("_values", F.struct("_time", "_order")).alias("_values"))
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        asked_spans.withColumn("_asked", F.lit(True))
        .join(last, ["_key", "_span"], "full")
        .withColumn("_carried", F.last("_values", ignorenulls=True).over(before))
        .filter("_asked")
        .select("_key", "_span", "_carried")
    )
    inside = known.join(asked_spans, ["_key", "_span"], "left_semi").withColumn("_row", F.lit(None).cast("bigint"))
    both = inside.unionByName(looked, allowMissingColumns=True).withColumn("_late", F.col("_row").isNotNull())
    so_far = Window.partitionBy("_key", "_span").orderBy("_time", "_late", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_values", ignorenulls=True).over(so_far)).filter("_late")
    found = found.join(carried, ["_key", "_span"], "left").select("_row", F.coalesce("_own", "_carried").alias("_values"))
    return asked.join(found, "_row", "left").select(*kept, *[F.col(f"_values.{c}").alias(c) for c in values])


def enrich_as_of(
    subscribers: DataFrame, feedback: DataFrame, at: str, sequence: Sequence[str] = (), time: str = "created_at"
) -> DataFrame:
    """Subscribers with the text and labels that they had at the time in their column ``at``, null without any by then.

    For training: features from after the time at which a subscriber's outcome starts to count would tell it.
    """
    labelled = feedback.withColumn("feedback_text", F.col("raw_text"))
    return as_of_join(subscribers, labelled, "customer_id", at, time, ("feedback_text", *LABEL_COLUMNS), sequence)
