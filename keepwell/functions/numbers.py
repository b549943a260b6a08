"""Score and percentage expressions. Rounding is half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def net_score(positive: Column, negative: Column, total: Column) -> Column:
    """Share of positive minus share of negative, moved to 0..100. Null without rows."""
    return F.when(total > 0, F.bround(((positive - negative) / total + 1) / 2 * 100, 0).cast("int"))


def percentage(part: Column, total: Column, digits: int = 1) -> Column:
    return F.when(total > 0, F.bround((part / total) * 100, digits))


def percent_text(value: Column) -> Column:
    """``5.8%``; ``0%`` where there is nothing to divide by."""
    return F.when(value.isNull(), F.lit("0%")).otherwise(F.concat(value.cast("string"), F.lit("%")))


def signed_text(value: Column) -> Column:
    return F.concat(F.when(value >= 0, F.lit("+")).otherwise(F.lit("")), value.cast("string"))


def ratio(part: Column, whole: Column) -> Column:
    """Division in which nothing over nothing is 0, as in a classification report."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
