import datetime
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepwell.functions import times
from keepwell.operators import reputation as rep
from keepwell.sources import readers, writers

NOW = datetime.datetime(2024, 3, 15, 12)


@pytest.fixture(scope="module")
def as_of(spark):
    return F.lit("2024-03-15 12:00:00").cast("timestamp")


def frame(spark, rows):
    schema = "sentiment string, created_at timestamp, username string, raw_text string, source string, feedback_category string, complaint_intensity int"
    full = [(s, t, "u", f"text {i}", "Facebook", "pricing", 1 + i % 5) for i, (s, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def days_ago(n):
    return NOW - datetime.timedelta(days=n)


def score(tones):
    counts = Counter(t.lower() for t in tones if t is not None)
    return round((((counts["positive"] - counts["negative"]) / len(tones)) + 1) / 2 * 100)


@pytest.mark.parametrize(
    "p, u, n, mix", [(19, 218, 88, ("5.8%", "67.1%", "27.1%")), (19, 213, 86, ("6.0%", "67.0%", "27.0%"))]
)
def test_known_counts(spark, p, u, n, mix):
    tones = ["positive"] * p + ["neutral"] * u + ["negative"] * n
    rows = frame(spark, [(t, NOW) for t in tones])
    assert rep.reputation_score(rows).first().score == 39
    assert tuple(rep.sentiment_mix(rows).first())[1:] == mix


def test_mean_intensity_of_known_counts(spark):
    levels = [1] * 199 + [2] * 50 + [3] * 49 + [4] * 27
    rows = spark.createDataFrame([("neutral", "pricing", i) for i in levels], "sentiment string, feedback_category string, complaint_intensity int")
    summary = {r.section: r for r in rep.feedback_summary(rows).collect()}
    assert summary["all"].records == 325 and summary["all"].average_intensity == 1.70


def test_all_rows_count(spark, as_of):
    tones = ["Positive", "POSITIVE", "negative", None, "angry", "neutral", "positive"]
    row = rep.reputation_dashboard(frame(spark, [(t, NOW) for t in tones]), as_of).first()
    assert row.score_out_of_100 == score(tones)
    assert (row.positive, row.neutral, row.negative) == (3, 1, 1)
    assert (row.positive_percentage, row.neutral_percentage) == ("42.9%", "14.3%")


def test_score_rounds_like_python(spark):
    sizes = (1, 2, 3, 7, 8, 40)
    cases = [(p, n, t) for t in sizes for p in range(t + 1) for n in range(t + 1 - p)]
    rows = spark.createDataFrame(cases, "p bigint, n bigint, t bigint")
    for r in rows.select("*", rep.net_score(F.col("p"), F.col("n"), F.col("t")).alias("got")).collect():
        tones = ["positive"] * r.p + ["negative"] * r.n + ["neutral"] * (r.t - r.p - r.n)
        assert r.got == score(tones) and 0 <= r.got <= 100


def test_variance(spark, as_of):
    rows = [("positive", days_ago(1))] * 3 + [("negative", days_ago(8))] * 2 + [("positive", days_ago(30))]
    got = rep.reputation_vs_last_week(frame(spark, rows), as_of).first()
    everything, old = score([r[0] for r in rows]), score([r[0] for r in rows if r[1] < days_ago(7)])
    assert (got.score, got.history_score) == (everything, old)
    assert got.vs_last_week == f"{everything - old:+d}"


def test_variance_signs(spark, as_of):
    worse = [("negative", days_ago(1)), ("positive", days_ago(9))]
    assert rep.reputation_vs_last_week(frame(spark, worse), as_of).first().vs_last_week == "-50"
    same = [("neutral", days_ago(1)), ("neutral", days_ago(9))]
    assert rep.reputation_vs_last_week(frame(spark, same), as_of).first().vs_last_week == "+0"
    fresh = [("negative", days_ago(7)), ("negative", days_ago(1))]
    assert rep.reputation_vs_last_week(frame(spark, fresh), as_of).first().vs_last_week == "+4"


def test_empty(spark, as_of):
    row = rep.reputation_dashboard(frame(spark, []), as_of).first()
    assert tuple(row) == (0, "0", 0, 0, 0, "No Data", "0%", "0%", "0%")
    document = json.loads(rep.reputation_document(frame(spark, []), as_of).first().document)
    assert document["sentiment_over_time"] == [] and document["recent_mentions"]["feed"] == []
    assert rep.reputation_summary(frame(spark, [])).first().net_reputation_score == 0.0


def test_times(spark, as_of):
    texts = ["2024-03-15T10:00:00", "2024-03-15T10:00:00+02:00", "2024-03-15 10:00:00Z", "junk", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, created_at string")
    got = rows.select("i", times.utc_text(times.event_time(rows, as_of)).alias("t")).orderBy("i").collect()
    hours = [r.t[11:16] for r in got]
    assert hours == ["10:00", "08:00", "10:00", "12:00", "12:00"]


def test_rows_without_time_count_as_now(spark, as_of):
    rows = frame(spark, [("positive", None), ("negative", days_ago(20))])
    assert [r.date for r in rep.sentiment_over_time(rows, as_of).collect()] == ["2024-02-24", "2024-03-15"]
    bare = rows.drop("created_at")
    assert [(r.date, r.volume) for r in rep.sentiment_over_time(bare, as_of).collect()] == [("2024-03-15", 2)]


def test_daily_scores(spark, as_of):
    rows = [("positive", days_ago(i % 5)) for i in range(12)] + [("negative", days_ago(i % 3)) for i in range(8)]
    got = {r.date: (r.daily_sentiment_score, r.volume) for r in rep.sentiment_over_time(frame(spark, rows), as_of).collect()}
    for date, (points, volume) in got.items():
        tones = [s for s, t in rows if t.strftime("%Y-%m-%d") == date]
        assert (points, volume) == (score(tones), len(tones))
    assert list(got) == sorted(got) and sum(v for _, v in got.values()) == len(rows)


def test_mentions(spark, as_of):
    rows = frame(spark, [("neutral", days_ago(i)) for i in range(15)])
    rows = rows.withColumn("source", F.when(F.col("complaint_intensity") == 1, "Web").otherwise("FACEBOOK"))
    got = rep.recent_mentions(rows, as_of).collect()
    assert [r.comment for r in got] == [f"text {i}" for i in range(15) if i % 5][:10]
    anonymous = rep.recent_mentions(rows.drop("source", "username", "sentiment"), as_of).first()
    assert (anonymous.user_name, anonymous.sentiment, anonymous.comment) == ("Utilisateur Anonyme", "neutral", "text 0")


def test_summary_bands(spark):
    status = lambda tones: rep.reputation_summary(frame(spark, [(t, NOW) for t in tones])).first().brand_health_status
    assert status(["positive"] * 3 + ["negative"]).startswith("Healthy")
    assert status(["positive", "negative"]).startswith("Stable")
    assert status(["negative"]).startswith("At Risk")


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = frame(spark, [("positive", days_ago(i % 3)) for i in range(9)])
    writers.write_snapshots(rows, path)
    writers.write_snapshots(frame(spark, [("negative", days_ago(1))]), path)
    got = [(str(r.snapshot_date), r.score, r.volume) for r in readers.read_snapshots(spark, path).collect()]
    assert got == [("2024-03-15", 100, 3), ("2024-03-14", 0, 1), ("2024-03-13", 100, 3)]
    one = readers.read_snapshots(spark, path, "2024-03-14")
    assert [r.volume for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan
