"""From comment boxes to the feedback table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from keepwell.operators.comments import extract_comments
from keepwell.operators.labels import LEXICON, comments_to_label, label_comments, lexicon_labels, parse_labels
from keepwell.operators.links import attach_post_date
from keepwell.operators.shaping import shape_feedback
from keepwell.operators.upsert import upsert_update
from keepwell.schemas import FEEDBACK, FEEDBACK_KEY
from keepwell.session import materialize
from keepwell.sources.readers import read_csv


def collect_comments(boxes: DataFrame, links: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Clean, de-duplicated comments with pseudonymous ids, the post's date label and the time of collection."""
    comments = attach_post_date(extract_comments(boxes, sequence), links)
    return comments.withColumn("scraped_at", F.current_timestamp())


def label_batch(
    comments: DataFrame,
    order_id: str,
    labeler: Callable | None = None,
    lexicon: Mapping[str, Sequence[str]] = LEXICON,
) -> DataFrame:
    """Feedback rows from comments, labelled by a function or else by keywords."""
    rows = comments_to_label(comments, order_id)
    labelled = label_comments(rows, labeler) if labeler else lexicon_labels(rows, lexicon)
    return shape_feedback(labelled, keep=[order_id])


def label_batch_from_answers(answers: DataFrame, order_id: str, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Feedback rows from (order_id, customer_id, username, raw_text, answer), and the quarantined answers."""
    rows, quarantine = parse_labels(answers, answer)
    return shape_feedback(rows, keep=[order_id]), quarantine


def update_feedback(feedback: DataFrame, batch: DataFrame, order_id: str) -> DataFrame:
    """The feedback table with a batch merged in, of repeated rows the first; new rows are created now."""
    now = {"created_at": F.current_timestamp()}
    # stored first, so that a labeller sees each comment once and every part of the merge the same labels
    return upsert_update(feedback, materialize(batch, "labelled"), FEEDBACK_KEY, [order_id], now, keep="first")


def empty_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FEEDBACK)


def read_feedback_export(spark: SparkSession, path: str, escaped: bool = False) -> DataFrame:
    """A labelled CSV export in file order (``POSITION``); columns it lacks stay absent.

    One with ``escaped`` line breaks is split among tasks; of any other, a task reads a file.
    """
    return read_csv(spark, path, FEEDBACK, multi_line=not escaped, with_position=True, escaped=escaped)
