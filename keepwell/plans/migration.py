"""One-time load of CSV exports into the tables. Running it again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepwell.operators.shaping import project_whitelist, shape_feedback
from keepwell.operators.upsert import upsert_update
from keepwell.plans.ingest import read_feedback_export
from keepwell.schemas import FEEDBACK_KEY, SUBSCRIBERS
from keepwell.sources.readers import POSITION, read_csv


def migrate_subscribers(spark: SparkSession, current: DataFrame, pattern: str) -> DataFrame:
    """The subscriber table with all rows of the matching files; of several per customer the last counts."""
    rows = read_csv(spark, pattern, SUBSCRIBERS, with_position=True)
    allowed = [*SUBSCRIBERS.fieldNames(), *POSITION]
    return upsert_update(current, project_whitelist(rows, allowed), ["customer_id"], POSITION)


def migrate_feedback(spark: SparkSession, current: DataFrame, path: str, escaped: bool = False) -> DataFrame:
    """The feedback table with all rows of an export; of several per customer and text the last counts.

    Two rows without a text are the same row, so a second run adds nothing."""
    rows = shape_feedback(read_feedback_export(spark, path, escaped), keep=POSITION)
    return upsert_update(current, rows, FEEDBACK_KEY, POSITION, {"created_at": F.current_timestamp()})
