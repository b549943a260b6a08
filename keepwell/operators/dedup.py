"""De-duplication and best-per-key selection.

All of these rank inside a key and keep the first rows. Spark prunes such
ranks before the shuffle (a window group limit), so a key that holds a large
part of the table sends only a few rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key. ``order`` must end in something unique."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str | Column], sequence: Sequence[str]) -> DataFrame:
    return top_per_key(df, keys, [F.col(c).asc() for c in sequence])


def keep_last(df: DataFrame, keys: Sequence[str | Column], sequence: Sequence[str]) -> DataFrame:
    return top_per_key(df, keys, [F.col(c).desc() for c in sequence])


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """All rows of all batches; columns are matched by name."""
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch, allowMissingColumns=True)
    return whole
