"""Brand reputation from the feedback table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepwell.functions.numbers import net_score, percent_text, percentage, signed_text
from keepwell.functions.times import date_text, days_before, event_time
from keepwell.operators.labels import CATEGORIES, SENTIMENTS
from keepwell.schemas import FEEDBACK_KEY, existing, first_existing

# Fixed values of the dashboard.
FRESH_VARIANCE = 4  # shown while there is nothing older than a week
NOBODY = "Utilisateur Anonyme"
ALL_TIME = "All Available Records"
NO_DATA = "No Data"
FEED = "Live feed from Facebook"

TONES = SENTIMENTS

# Bands of the older summary: lowest net score (-100..100) and what it is called. The limits and two names are ours.
HEALTH_BANDS = ((20.0, "Healthy / Positive Brand Perception"), (-10.0, "Stable / Mixed Brand Perception"))
HEALTH_BELOW = "At Risk / Negative Operational Friction"  # fixed value


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def tone_counts(condition: Column | None = None, prefix: str = "") -> list[Column]:
    tone = F.lower(F.col("sentiment"))
    within = F.lit(True) if condition is None else condition
    return [F.count_if(within & (tone == name)).alias(prefix + name) for name in TONES]


def _counts(feedback: DataFrame, now: Column) -> list[Column]:
    """All rows and rows older than a week, each with their tones."""
    old = event_time(feedback, now) < days_before(now, 7)
    return [
        F.count("*").alias("total"),
        *tone_counts(),
        F.count_if(old).alias("history_total"),
        *tone_counts(old, "history_"),
    ]


def _with_scores(counts: DataFrame) -> DataFrame:
    """Score, trend and shares beside the counts they follow from."""
    total = F.col("total")
    scored = counts.withColumns(
        {
            "score": F.coalesce(net_score(F.col("positive"), F.col("negative"), total), F.lit(0)),
            "history_score": net_score(F.col("history_positive"), F.col("history_negative"), F.col("history_total")),
            **{f"{t}_share": percentage(F.col(t), total) for t in TONES},
        }
    )
    variance = F.coalesce(F.col("score") - F.col("history_score"), F.lit(FRESH_VARIANCE))
    return scored.withColumns(
        {
            "vs_last_week": F.when(total == 0, F.lit("0")).otherwise(signed_text(variance)),
            "selected_period": F.when(total == 0, F.lit(NO_DATA)).otherwise(F.lit(ALL_TIME)),
        }
    )


def overall(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Every scalar of the dashboard in one row, from one pass over the feedback.

    ``total`` counts all rows, also those without a known sentiment. Spark
    prunes the aggregates a caller doesn't select.
    """
    return _with_scores(feedback.agg(*_counts(feedback, _now(as_of))))


def sentiment_distribution(feedback: DataFrame) -> DataFrame:
    return overall(feedback).select(*TONES)


def reputation_score(feedback: DataFrame) -> DataFrame:
    return overall(feedback).select("total", "score")


def reputation_vs_last_week(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The score of all rows against that of rows older than seven days."""
    return overall(feedback, as_of).select("score", "history_total", "history_score", "vs_last_week")


def sentiment_mix(feedback: DataFrame) -> DataFrame:
    return overall(feedback).select("selected_period", *[percent_text(F.col(f"{t}_share")).alias(t) for t in TONES])


def reputation_dashboard(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Score, trend, distribution and mix in one row; all zero without feedback."""
    return overall(feedback, as_of).select(
        F.col("score").alias("score_out_of_100"),
        "vs_last_week",
        *TONES,
        "selected_period",
        *[percent_text(F.col(f"{t}_share")).alias(f"{t}_percentage") for t in TONES],
    )


def _per_day(feedback: DataFrame, now: Column) -> DataFrame:
    day = F.to_date(event_time(feedback, now)).alias("snapshot_date")
    counts = feedback.groupBy(day).agg(*_counts(feedback, now))
    return counts.withColumn("score", net_score(F.col("positive"), F.col("negative"), F.col("total")))


def daily_counts(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per day: score, volume and tones."""
    days = _per_day(feedback, _now(as_of))
    return days.select("snapshot_date", "score", F.col("total").alias("volume"), *TONES)


def sentiment_over_time(feedback: DataFrame, as_of: Column | None = None) -> DataFrame:
    return (
        daily_counts(feedback, as_of)
        .orderBy("snapshot_date")
        .select(
            date_text(F.col("snapshot_date")).alias("date"),
            F.col("score").alias("daily_sentiment_score"),
            "volume",
        )
    )


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(section, item, records, average_intensity) by sentiment, by category and for all rows.

    The table is reduced to its few label combinations first; the sections are built from those.
    """
    combos = feedback.groupBy("sentiment", "feedback_category").agg(
        F.count("*").alias("n"),
        F.count("complaint_intensity").alias("rated"),
        F.sum("complaint_intensity").alias("intensity"),
    )
    items = {"sentiment": F.col("sentiment"), "category": F.col("feedback_category"), "all": F.lit("all")}
    sections = [F.struct(F.lit(name).alias("section"), item.alias("item")) for name, item in items.items()]
    lines = combos.select(F.inline(F.array(*sections)), "n", "rated", "intensity").filter("item IS NOT NULL")
    return (
        lines.groupBy("section", "item")
        .agg(
            F.sum("n").alias("records"),
            F.bround(F.try_divide(F.sum("intensity"), F.sum("rated")), 2).alias("average_intensity"),
        )
        .orderBy("section", F.desc("records"), "item")
    )


def _newest(
    feedback: DataFrame, now: Column, n: int, source: str, tie_break: Sequence[str]
) -> tuple[DataFrame, list[Column]]:
    """The newest ``n`` rows with their time ``_at``, and the fields shown of a mention."""
    rows = feedback
    if "source" in feedback.columns:
        rows = rows.filter(F.lower(F.col("source")) == source.lower())
    tie_break = existing(feedback, tie_break)
    moment = event_time(feedback, now)
    newest = rows.withColumn("_at", moment).orderBy(F.desc("_at"), *[F.desc(c) for c in tie_break]).limit(n)
    return newest, [
        first_existing(feedback, ["username", "user_name"], NOBODY).alias("user_name"),
        first_existing(feedback, ["raw_text", "feedback_text"], "").alias("comment"),
        first_existing(feedback, ["sentiment"], "neutral").alias("sentiment"),
        date_text(F.col("_at")).alias("timestamp"),
    ]


def recent_mentions(
    feedback: DataFrame,
    as_of: Column | None = None,
    n: int = 10,
    source: str = "facebook",
    tie_break: Sequence[str] = tuple(FEEDBACK_KEY),
) -> DataFrame:
    """The newest ``n`` mentions from one source (from all, if the table has no ``source``).

    ``tie_break`` orders mentions of one moment; together with the time it is unique. Its default is the table's key.
    """
    newest, fields = _newest(feedback, _now(as_of), n, source, tie_break)
    return newest.select(*fields)


def reputation_summary(feedback: DataFrame) -> DataFrame:
    """The older summary: net score on -100..100, mean intensity, tones, complaints per category, status."""
    counts = feedback.agg(
        F.count("*").alias("total_records"),
        F.bround(F.avg("complaint_intensity"), 1).alias("average_complaint_intensity"),
        *tone_counts(),
        *[F.count_if(F.col("feedback_category") == c).alias(c) for c in CATEGORIES],
    )
    net = F.when(
        F.col("total_records") > 0,
        F.bround((F.col("positive") - F.col("negative")) / F.col("total_records") * 100, 1),
    ).otherwise(0.0)
    status = F.when(F.col("total_records") == 0, F.lit(NO_DATA))
    for lowest, name in HEALTH_BANDS:
        status = status.when(F.col("net_reputation_score") >= lowest, F.lit(name))
    return counts.withColumn("net_reputation_score", net).withColumn(
        "brand_health_status", status.otherwise(F.lit(HEALTH_BELOW))
    )


def reputation_document(
    feedback: DataFrame, as_of: Column | None = None, tie_break: Sequence[str] = tuple(FEEDBACK_KEY)
) -> DataFrame:
    """The whole dashboard as one JSON text.

    The feedback is counted per day in one pass; the totals are sums over days.
    The lists hold one entry per calendar day and the ten newest mentions.
    """
    now = _now(as_of)
    sums = [
        F.coalesce(F.sum(prefix + name), F.lit(0)).alias(prefix + name)
        for prefix in ("", "history_")
        for name in ("total", *TONES)
    ]
    day = F.struct(
        date_text(F.col("snapshot_date")).alias("date"),
        F.col("score").alias("daily_sentiment_score"),
        F.col("total").alias("volume"),
    )
    row = _with_scores(_per_day(feedback, now).agg(*sums, F.sort_array(F.collect_list(day)).alias("days")))
    newest, fields = _newest(feedback, now, 10, "facebook", tie_break)
    entries = F.collect_list(F.struct("_at", *existing(feedback, tie_break), F.struct(*fields).alias("mention")))
    feed = newest.agg(F.transform(F.sort_array(entries, asc=False), lambda entry: entry["mention"]))
    shares = [percent_text(F.col(f"{t}_share")).alias(t) for t in TONES]
    document = F.struct(
        F.struct(F.col("score").alias("score_out_of_100"), "vs_last_week").alias("overall_sentiment"),
        F.struct(*TONES).alias("distribution"),
        F.col("days").alias("sentiment_over_time"),
        F.struct("selected_period", *shares).alias("sentiment_mix_percentage"),
        F.struct(F.lit(FEED).alias("platform_source"), feed.scalar().alias("feed")).alias("recent_mentions"),
    )
    return row.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def trend_over_time(feedback: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """For every day with feedback what ``reputation_vs_last_week`` showed after its last row: ``date``, ``total``, ``score``,
    ``history_total``, ``history_score``, ``vs_last_week``.

    Rows are counted per day; running sums over the days, framed by range, give all rows so far and those of whole days before
    the week. The day on which the week begins is split at the time of the later day's last row, by one join of each row
    with the one day that it may be split for. Only days, not rows, are put in order in one task.
    """
    now = _now(as_of)
    counts = ("total", *TONES)
    timed = feedback.select("sentiment", event_time(feedback, now).alias("_time")).withColumn("_day", F.to_date("_time"))
    per_day = timed.groupBy("_day").agg(F.max("_time").alias("_until"), F.count("*").alias("total"), *tone_counts())
    ends = per_day.select(F.date_sub("_day", days).alias("_day"), days_before(F.col("_until"), days).alias("_end"))
    split = timed.join(ends, "_day").filter("_time < _end").groupBy(F.date_add("_day", days).alias("_day"))
    split = split.agg(F.count("*").alias("part_total"), *tone_counts(prefix="part_"))
    order = Window.orderBy("_number")
    so_far, before = (order.rangeBetween(Window.unboundedPreceding, end) for end in (0, -days - 1))
    numbered = per_day.join(split, "_day", "left").withColumn("_number", F.datediff("_day", F.lit("1970-01-01").cast("date")))
    summed = numbered.select("_day", *[F.sum(c).over(so_far).alias(c) for c in counts], *[
        (F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(f"part_{c}", F.lit(0))).alias(f"history_{c}") for c in counts
    ])
    scored = _with_scores(summed)
    return scored.select(date_text(F.col("_day")).alias("date"), "total", "score", "history_total", "history_score", "vs_last_week")
