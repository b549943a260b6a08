"""Data health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

WATCHED = ("feedback_category", "sentiment", "complaint_intensity")


def _is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def data_audit(df: DataFrame, watched: Sequence[str] = WATCHED) -> DataFrame:
    """(metric, value): rows, columns, missing values in all columns and in each watched one.

    One aggregation over the table.
    """
    watched = [c for c in watched if c in df.columns]
    missing = {c: F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)}
    counts = df.agg(F.count("*").alias("rows"), *missing.values())
    position = {c: f"m{i}" for i, c in enumerate(df.columns)}
    total = F.lit(0).cast("bigint")
    for name in position.values():
        total = total + F.col(name)
    metrics = [
        ("rows", F.col("rows")),
        ("columns", F.lit(len(df.columns)).cast("bigint")),
        ("missing_total", total),
        *[(f"missing_{c}", F.col(position[c])) for c in watched],
    ]
    lines = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics])
    return counts.select(F.inline(lines))
