import json

import pytest

from pyspark.sql import functions as F

from keepwell.operators import labels
from keepwell.plans import ingest

DEFAULTS = ("service_quality", "neutral", 1)

ANSWERS = [
    '{"results":[{"customer_id":"other","feedback_category":"pricing","sentiment":"negative","complaint_intensity":3}]}',
    '{"results":[{"sentiment":"positive"},{"complaint_intensity":4}]}',
    "{bad",
    "",
    '{"x":1}',
    '{"results":[]}',
    '{"results":[{"sentiment":null,"feedback_category":"pricing"}]}',
    '{"results":null}',
    '{"results":"abc"}',
    '{"results":[{"sentiment":"positive"},5,{"sentiment":"negative"}]}',
    "[1,2]",
    "7",
    '{"results":[{}]}',
    '{"results":[{"complaint_intensity":"5"}]}',
]


def reader(text):
    """(rows, quarantined) as a careful reader of one answer gives them."""
    try:
        answer = json.loads(text)
    except ValueError:
        return [DEFAULTS], False
    if not isinstance(answer, dict):
        return [], True
    items = answer.get("results", [])
    if not isinstance(items, list):
        return [], True
    rows = []
    for item in items:
        if not isinstance(item, dict):
            return rows, True
        keys = ("feedback_category", "sentiment", "complaint_intensity")
        row = [item.get(k, d) for k, d in zip(keys, DEFAULTS)]
        rows.append((row[0], row[1], int(row[2])))
    return rows, False


def test_parse_labels(spark):
    rows = [(i, f"c{i}", "name", "text", a) for i, a in enumerate(ANSWERS)]
    frame = spark.createDataFrame(rows, "seq int, customer_id string, username string, raw_text string, answer string")
    good, bad = labels.parse_labels(frame)
    got = sorted(
        [(r.seq, r.feedback_category, r.sentiment, r.complaint_intensity) for r in good.collect()], key=repr
    )
    want = sorted([(i, *row) for i, a in enumerate(ANSWERS) for row in reader(a)[0]], key=repr)
    assert got == want
    assert {r.customer_id for r in good.collect()} <= {f"c{i}" for i in range(len(ANSWERS))}
    assert sorted(r.seq for r in bad.collect()) == [i for i, a in enumerate(ANSWERS) if reader(a)[1]]
    assert all(r.reason for r in bad.collect())


def test_lexicon(spark):
    texts = ["غالي بزاف", "زوين", "سيرفيس عيان غالي", "غادي نلغي حيت غالي", "hello"]
    frame = spark.createDataFrame([(t,) for t in texts], "raw_text string")
    got = [r.feedback_category for r in labels.lexicon_labels(frame).collect()]
    assert got == ["pricing", "service_quality", "customer_support", "churn_intent", "service_quality"]


def test_label_comments_without_labeler_stays_in_the_jvm(spark):
    plan = labels.label_comments(spark.createDataFrame([("x",)], "raw_text string"))
    assert "mapinpandas" not in plan._jdf.queryExecution().toString().lower()


def test_comments_to_label(spark):
    frame = spark.createDataFrame([(3, " a "), (4, " ")], "seq int, text string")
    rows = labels.comments_to_label(frame, "seq").collect()
    assert [tuple(r) for r in rows] == [(3, "unknown_3", "Anonymous User", "a")]


def test_batch_updates_feedback(spark):
    def angry(batch):
        return batch.assign(feedback_category="pricing", sentiment="negative", complaint_intensity=5)

    comments = spark.createDataFrame(
        [(1, "c1", "Ali", "too dear"), (2, "c1", "Ali2", "too dear"), (3, "c2", "Sara", "fine")],
        "seq int, customer_id string, username string, text string",
    )
    first = ingest.update_feedback(ingest.empty_feedback(spark), ingest.label_batch(comments, "seq", angry), "seq")
    rows = {(r.customer_id, r.raw_text): r for r in first.collect()}
    assert sorted(rows) == [("c1", "too dear"), ("c2", "fine")]
    assert rows["c1", "too dear"].username == "Ali"
    assert rows["c2", "fine"].source == "Facebook" and rows["c2", "fine"].created_at is not None

    stored = first.withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    calm = ingest.label_batch(comments.filter("seq = 3"), "seq")
    again = {r.customer_id: r for r in ingest.update_feedback(stored, calm, "seq").collect()}
    assert (again["c1"].sentiment, again["c2"].sentiment) == ("negative", "neutral")
    assert again["c2"].created_at.year == 2024


def test_a_labeller_that_loses_rows_is_an_error(spark):
    comments = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "i int, raw_text string").coalesce(1)

    def every_second(batch):
        return batch.iloc[::2].assign(feedback_category="pricing", sentiment="neutral", complaint_intensity=1)

    with pytest.raises(Exception, match="10 rows for 20"):
        labels.label_comments(comments, every_second).collect()


def test_a_labeller_sees_each_comment_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, f"c{i}", "u", f"text {i}") for i in range(20)]
    comments = spark.createDataFrame(rows, "order_id int, customer_id string, username string, text string")

    def counting(batch):
        seen.add(len(batch))
        return batch.assign(feedback_category="pricing", sentiment="neutral", complaint_intensity=1)

    batch = ingest.label_batch(comments, "order_id", counting)
    assert ingest.update_feedback(ingest.empty_feedback(spark), batch, "order_id").count() == 20 and seen.value == 20


def test_a_labeller_may_not_change_rows(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(6)], "customer_id string, raw_text string").coalesce(1)

    def label(batch, frame):
        return frame.assign(feedback_category="pricing", sentiment="neutral", complaint_intensity=1)

    good = labels.label_comments(rows, lambda b: label(b, b)).collect()
    assert len(good) == 6
    for wrong in (
        lambda b: label(b, b.assign(raw_text=list(b["raw_text"])[::-1])),
        lambda b: label(b, b.iloc[[0, 0, 2, 3, 4, 5]]),
        lambda b: label(b, b.iloc[:5]),
    ):
        with pytest.raises(Exception, match="labeller returned"):
            labels.label_comments(rows, wrong).collect()
