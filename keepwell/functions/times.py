"""Time expressions. The session runs in UTC (see ``session.prepare``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def parse_utc(text: Column) -> Column:
    """ISO text to a timestamp: offsets count, zone-less text is UTC, junk is null."""
    return F.try_to_timestamp(text)


def event_time(df: DataFrame, as_of: Column, name: str = "created_at") -> Column:
    """The time of a row; ``as_of`` where it is absent, null or unreadable."""
    if name not in df.columns:
        return as_of
    column = F.col(name)
    parsed = parse_utc(column) if isinstance(df.schema[name].dataType, T.StringType) else column.cast("timestamp")
    return F.coalesce(parsed, as_of)


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL {days} DAYS")


def date_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")
