"""Reputation queries over the feedback view."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.catalog import query, views
from keepwell.catalog.views import feedback, newest, with_views
from keepwell.functions import times
from keepwell.operators import reputation as rep
from keepwell.session import scratch_path
from keepwell.sources.readers import read_snapshots
from keepwell.sources.writers import write_snapshots

_TONES = ", ".join(f"count(CASE WHEN lower(sentiment) = '{t}' THEN 1 END) AS {t}" for t in rep.TONES)


def _score(p: str, n: str, total: str) -> str:
    return f"CAST(round_even((({p} - {n}) / {total} + 1) / 2 * 100, 0) AS INTEGER)"


_DAILY = f"""SELECT day, volume, positive, neutral, negative, {_score('positive', 'negative', 'volume')} AS score
FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS volume, {_TONES} FROM feedback GROUP BY 1)"""

_OVERALL = f"""SELECT *, {_score('positive', 'negative', 'total')} AS score,
       CASE WHEN h_total > 0 THEN {_score('h_positive', 'h_negative', 'h_total')} END AS history_score
FROM (SELECT count(*) AS total, {_TONES},
             count(CASE WHEN old THEN 1 END) AS h_total,
             count(CASE WHEN old AND lower(sentiment) = 'positive' THEN 1 END) AS h_positive,
             count(CASE WHEN old AND lower(sentiment) = 'negative' THEN 1 END) AS h_negative
      FROM (SELECT *, created_at < (SELECT max(created_at) FROM feedback) - INTERVAL 7 DAY AS old FROM feedback))"""

_SIGNED = """CASE WHEN score - history_score >= 0 THEN '+' ELSE '' END || CAST(score - history_score AS VARCHAR)"""


def _share(tone: str) -> str:
    return f"CAST(round_even({tone} / total * 100, 1) AS VARCHAR) || '%'"


@query("sentiment_over_time", with_views("feedback", f"""
SELECT strftime(day, '%Y-%m-%d') AS date, score AS daily_sentiment_score, volume FROM ({_DAILY}) ORDER BY 1"""))
def _(spark, sf_dir):
    return rep.sentiment_over_time(feedback(spark, sf_dir))


@query("sentiment_distribution", with_views("feedback", f"SELECT {_TONES} FROM feedback"))
def _(spark, sf_dir):
    return rep.sentiment_distribution(feedback(spark, sf_dir))


@query("reputation_score", with_views("feedback", f"SELECT total, score FROM ({_OVERALL})"))
def _(spark, sf_dir):
    return rep.reputation_score(feedback(spark, sf_dir))


@query("reputation_vs_last_week", with_views("feedback", f"""
SELECT score, h_total AS history_total, history_score, {_SIGNED} AS vs_last_week FROM ({_OVERALL})"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    return rep.reputation_vs_last_week(rows, newest(rows))


_SO_FAR = f"""SELECT d.day, count(*) AS total, {_TONES}, count(CASE WHEN old THEN 1 END) AS h_total,
             count(CASE WHEN old AND lower(sentiment) = 'positive' THEN 1 END) AS h_positive,
             count(CASE WHEN old AND lower(sentiment) = 'negative' THEN 1 END) AS h_negative
FROM (SELECT CAST(created_at AS DATE) AS day, max(created_at) AS until FROM feedback GROUP BY 1) d
JOIN (SELECT sentiment, created_at FROM feedback) f ON f.created_at <= d.until,
LATERAL (SELECT f.created_at < d.until - INTERVAL 7 DAY AS old) GROUP BY d.day"""


# What the dashboard showed after each day; the last day is reputation_vs_last_week.
@query("trend_over_time", with_views("feedback", f"""
SELECT strftime(day, '%Y-%m-%d') AS date, total, score, h_total AS history_total, history_score,
       coalesce({_SIGNED}, '+4') AS vs_last_week
FROM (SELECT *, {_score('positive', 'negative', 'total')} AS score,
             CASE WHEN h_total > 0 THEN {_score('h_positive', 'h_negative', 'h_total')} END AS history_score FROM ({_SO_FAR}))"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    return rep.trend_over_time(rows, newest(rows))


@query("sentiment_mix", with_views("feedback", f"""
SELECT 'All Available Records' AS selected_period,
       {', '.join(f'{_share(t)} AS {t}' for t in rep.TONES)} FROM ({_OVERALL})"""))
def _(spark, sf_dir):
    return rep.sentiment_mix(feedback(spark, sf_dir))


@query("reputation_dashboard", with_views("feedback", f"""
SELECT score AS score_out_of_100, {_SIGNED} AS vs_last_week, positive, neutral, negative,
       'All Available Records' AS selected_period,
       {', '.join(f'{_share(t)} AS {t}_percentage' for t in rep.TONES)} FROM ({_OVERALL})"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    return rep.reputation_dashboard(rows, newest(rows))


# The whole table is searched for a source it doesn't have.
@query("reputation_empty", with_views("feedback", """
SELECT CAST(count(*) AS INTEGER) AS score_out_of_100, '0' AS vs_last_week, count(*) AS positive, count(*) AS neutral,
       count(*) AS negative, 'No Data' AS selected_period, '0%' AS positive_percentage, '0%' AS neutral_percentage,
       '0%' AS negative_percentage
FROM feedback WHERE lower(source) = 'forum'"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir).filter(F.lower("source") == "forum")
    return rep.reputation_dashboard(rows, newest(rows))


@query("feedback_summary", with_views("feedback", """
SELECT section, item, count(*) AS records, round_even(avg(complaint_intensity), 2) AS average_intensity
FROM (SELECT 'sentiment' AS section, sentiment AS item, complaint_intensity FROM feedback
      UNION ALL SELECT 'category', feedback_category, complaint_intensity FROM feedback
      UNION ALL SELECT 'all', 'all', complaint_intensity FROM feedback)
GROUP BY section, item"""))
def _(spark, sf_dir):
    return rep.feedback_summary(feedback(spark, sf_dir))


_MENTIONS = """SELECT username AS user_name, raw_text AS comment, sentiment,
       strftime(created_at, '%Y-%m-%d') AS timestamp
FROM feedback WHERE lower(source) = 'facebook' ORDER BY created_at DESC, seq DESC LIMIT 10"""


@query("recent_mentions", with_views("feedback", _MENTIONS))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    return rep.recent_mentions(rows, newest(rows), tie_break=["seq"])


_CATEGORIES = ", ".join(
    f"count(CASE WHEN feedback_category = '{c}' THEN 1 END) AS {c}"
    for c in ("pricing", "service_quality", "customer_support", "churn_intent")
)


@query("reputation_summary", with_views("feedback", f"""
SELECT *, CASE WHEN net_reputation_score >= 20 THEN 'Healthy / Positive Brand Perception'
               WHEN net_reputation_score >= -10 THEN 'Stable / Mixed Brand Perception'
               ELSE 'At Risk / Negative Operational Friction' END AS brand_health_status
FROM (SELECT count(*) AS total_records, round_even(avg(complaint_intensity), 1) AS average_complaint_intensity,
             {_TONES}, {_CATEGORIES},
             round_even((count(CASE WHEN lower(sentiment) = 'positive' THEN 1 END) -
                         count(CASE WHEN lower(sentiment) = 'negative' THEN 1 END)) / count(*) * 100, 1)
               AS net_reputation_score
      FROM feedback)"""))
def _(spark, sf_dir):
    return rep.reputation_summary(feedback(spark, sf_dir))


@query("reputation_snapshot", with_views("feedback", f"""
SELECT strftime(day, '%Y-%m-%d') AS snapshot_date, score, volume, positive, neutral, negative FROM ({_DAILY})
ORDER BY 1 DESC"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    write_snapshots(feedback(spark, sf_dir), path)
    return read_snapshots(spark, path).withColumn("snapshot_date", times.date_text(F.col("snapshot_date")))


@query("reputation_snapshot_of_day", with_views("feedback", f"""
SELECT strftime(day, '%Y-%m-%d') AS snapshot_date, score, volume FROM ({_DAILY}) WHERE day = DATE '2024-01-15'"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    write_snapshots(feedback(spark, sf_dir), path)
    day = read_snapshots(spark, path, "2024-01-15")
    return day.select(times.date_text(F.col("snapshot_date")).alias("snapshot_date"), "score", "volume")


@query("reputation_document", with_views("feedback", f"""
SELECT CAST(to_json({{
    'overall_sentiment': {{'score_out_of_100': score, 'vs_last_week': {_SIGNED}}},
    'distribution': {{'positive': positive, 'neutral': neutral, 'negative': negative}},
    'sentiment_over_time': (SELECT list({{'date': strftime(day, '%Y-%m-%d'), 'daily_sentiment_score': d.score,
                                         'volume': volume}} ORDER BY day) FROM ({_DAILY}) d),
    'sentiment_mix_percentage': {{'selected_period': 'All Available Records',
        {', '.join(f"'{t}': {_share(t)}" for t in rep.TONES)}}},
    'recent_mentions': {{'platform_source': 'Live feed from Facebook',
        'feed': (SELECT list({{'user_name': username, 'comment': raw_text, 'sentiment': sentiment,
                              'timestamp': strftime(created_at, '%Y-%m-%d')}} ORDER BY created_at DESC, seq DESC)
                 FROM (SELECT * FROM feedback WHERE lower(source) = 'facebook'
                       ORDER BY created_at DESC, seq DESC LIMIT 10))}}
}}) AS VARCHAR) AS document FROM ({_OVERALL})"""))
def _(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    return rep.reputation_document(rows, newest(rows), tie_break=["seq"])


@query("parse_timestamps", """
SELECT event_id, strftime(CASE event_id % 5
    WHEN 0 THEN newest WHEN 1 THEN ts WHEN 2 THEN ts - INTERVAL 2 HOUR WHEN 3 THEN newest ELSE ts END,
  '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM (SELECT event_id, ts, (SELECT max(ts) FROM events) AS newest FROM events)""")
def _(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, "not a time")
        .when(kind == 1, iso)
        .when(kind == 2, F.concat(iso, F.lit("+02:00")))
        .when(kind == 4, F.concat(iso, F.lit("Z")))
    )
    rows = events.select("event_id", text.alias("created_at"))
    now = newest(events, "ts").cast("timestamp")
    return rows.select("event_id", times.utc_text(times.event_time(rows, now)).alias("created_at"))
