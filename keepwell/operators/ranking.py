"""Positions in a total order, without sorting the table in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepwell.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def partition_of(row_id: str) -> Column:
    """The partition in a ``monotonically_increasing_id``."""
    return F.shiftright(row_id, _ROW_BITS)


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the 0-based position of each row in its group.

    For groups as few as the columns of a table, of any size. Spark sorts by range into partitions and numbers the rows of each; the
    sizes of the partitions before it (one number per partition) turn that
    into a global position.
    """
    numbered = df.orderBy(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    stored = materialize(numbered, "ranked").withColumns({"_part": partition_of("_id"), "_row": row})
    pieces = stored.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = stored.join(starts, [*group, "_part"])  # at most a row per partition of the sort and one more per group
    return placed.select(*df.columns, (F.col("_start") + F.col("_row") - F.col("_first")).alias(name))


def hashed_position(df: DataFrame, group: str, key: str, per_bucket: int = 50_000) -> tuple[DataFrame, Column]:
    """``df`` in a shuffled but repeatable order inside each group, for few groups of any size.

    The order is that of the MD5 of ``key``. Its first hex digits name a
    bucket, as many digits as make a bucket of about ``per_bucket`` rows or less, so that a group is
    spread over many tasks; the sizes of the buckets give the start of each. Returns the frame
    and the column with the 0-based position, null where ``group`` is null.
    """
    buckets_hex = 1 + int(math.log(max(1, df.count() / per_bucket), 16))
    digest = F.md5(F.col(key).cast("string"))
    marked = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, buckets_hex))
    sizes = marked.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_digest", key)
    rows = marked.withColumn("_row", F.row_number().over(inside) - 1)
    placed = rows.join(starts, [group, "_bucket"], "left")  # rows are partitioned and sorted like this already
    return placed, F.col("_start") + F.col("_row")
