"""Writers. A table that is being read is never overwritten: upserts write beside it."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keepwell.functions.text import escape_breaks
from keepwell.functions.times import event_time
from keepwell.operators.reputation import daily_counts
from keepwell.operators.shaping import with_defaults
from keepwell.operators.upsert import bucketed_merge, new_rows, one_per_key, upsert_update
from keepwell.schemas import COMMENTS, FEEDBACK_EXPORT, PREDICTIONS, SUBSCRIBERS, conform, existing
from keepwell.session import materialize

JDBC_BATCH = 500


def append_comments(comments: DataFrame, path: str) -> bool:
    """Append to the comment table; a missing ``scraped_at`` is now. False if there was nothing to write."""
    if comments.isEmpty():
        return False
    stamped = with_defaults(comments, {"scraped_at": F.current_timestamp()}, fill_nulls=True)
    columns = [c for c in COMMENTS.fieldNames() if c != "associated_post_date"]
    stamped.select(*columns).write.mode("append").parquet(path)
    return True


def append_subscribers(subscribers: DataFrame, path: str) -> None:
    subscribers.select(*existing(subscribers, SUBSCRIBERS.fieldNames())).write.mode("append").parquet(path)


def append_predictions(records: DataFrame, path: str) -> None:
    conform(records, PREDICTIONS).write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a database table in batches of 500 rows per partition."""
    settings = {"url": url, "dbtable": table, "batchsize": str(JDBC_BATCH), **options}
    df.write.format("jdbc").options(**settings).mode("append").save()


def export_feedback_csv(feedback: DataFrame, path: str, escaped: bool = False) -> None:
    """The labelled feedback, with a header, quotes doubled.

    ``escaped`` writes line breaks in texts as ``\\n`` and ``\\r`` and a backslash as two, so that a line is a row and
    readers (``read_csv(..., escaped=True)``) can split a file among tasks. Without it, a file is read by one task.
    """
    columns = feedback.select(*existing(feedback, FEEDBACK_EXPORT))
    if escaped:
        texts = [f.name for f in columns.schema if isinstance(f.dataType, T.StringType)]
        columns = columns.withColumns({c: escape_breaks(F.col(c)) for c in texts})
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    columns.write.options(header=True, escape='"', **exact).csv(path)


def export_comments(comments: DataFrame, base: str, moment: datetime.datetime | None = None) -> str:
    """Write JSON lines to a directory named after the moment; returns its path."""
    stamp = (moment or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{base.rstrip('/')}/comments_{stamp}"
    comments.write.json(path)
    return path


def write_upsert(
    spark: SparkSession,
    target_path: str,
    batch: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    out_path: str,
    defaults: Mapping[str, Column] | None = None,
    keep: str = "last",
) -> None:
    """The upserted table, complete, at ``out_path``; then point readers there."""
    upsert_update(spark.read.parquet(target_path), batch, keys, sequence, defaults, keep).write.parquet(out_path)


def append_new(
    spark: SparkSession,
    target_path: str,
    batch: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
) -> None:
    """Append the batch rows whose keys the table lacks. The table itself isn't rewritten."""
    target = spark.read.parquet(target_path)
    unique = one_per_key(batch, target, keys, sequence, "first")
    new_rows(target, unique, keys, defaults).write.mode("append").parquet(target_path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` as the catalog table ``name`` at ``path``, laid out and sorted by ``keys`` in ``buckets`` files or so.

    Joins on exactly these keys read it in place. Rows are dealt to the buckets before they are written, so that each bucket
    is one file, not one per task.
    """
    spread = df.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def upsert_bucketed(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: Sequence[str], name: str, path: str, buckets: int
) -> DataFrame:
    """The table ``target`` from ``write_bucketed`` upserted by a batch of complete rows, as the new bucketed table ``name``.

    Only the batch is shuffled for the look-up, to the target's ``buckets``. Keys that are null are no keys of the layout: rows
    that have one are an error.
    """
    unique = one_per_key(batch.select(*target.columns), target, keys, sequence)
    said = F.raise_error(F.lit("a key of the batch is null")).cast("boolean")
    unique = unique.filter(F.when(F.least(*[F.col(k).isNotNull() for k in keys], F.lit(True)), F.lit(True)).otherwise(said))
    return write_bucketed(bucketed_merge(target, unique, keys), name, path, keys, buckets)


def write_snapshots(feedback: DataFrame, path: str, changed: DataFrame | None = None) -> None:
    """One partition per day. The days of ``feedback`` are replaced, others kept.

    ``feedback`` is the whole table. With ``changed``, the rows that are new in it, only their days are counted again,
    each from all its rows; new rows alone would replace a day by a part of it.
    """
    if changed is not None:
        days = changed.select(F.to_date(event_time(changed, F.current_timestamp())).alias("_day")).distinct()
        day = F.to_date(event_time(feedback, F.current_timestamp()))
        feedback = feedback.join(materialize(days, "days"), day == F.col("_day"), "left_semi")
    (
        daily_counts(feedback)
        .repartition("snapshot_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )
