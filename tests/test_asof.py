"""Joins as of a time against a plain version."""

import random
from datetime import datetime, timedelta

import pytest

from keepwell.operators.asof import as_of_join, enrich_as_of

START = datetime(2024, 1, 1)


def _plain(rows, history):
    out = []
    for row_id, key, at in rows:
        own = [h for h in history if key is not None and at is not None and h[0] == key and h[1] is not None and h[1] <= at]
        best = max(own, key=lambda h: (h[1], h[2])) if own else None
        out.append((row_id, best[3] if best else None))
    return sorted(out)


@pytest.mark.parametrize("seconds", [60, 86_400])
def test_the_last_row_by_then(spark, seconds):
    rng = random.Random(7)

    def time():
        return None if rng.random() < 0.05 else START + timedelta(seconds=rng.randrange(0, 5 * 86_400, 45))

    keys = ["hot"] * 6 + ["a", "b", "c", None]
    history = [(rng.choice(keys), time(), i, f"v{i}") for i in range(900)]
    history += [("tie", START, 1, "first"), ("tie", START, 2, "last"), ("later", START + timedelta(days=9), 3, "future")]
    rows = [(i, rng.choice([*keys, "none"]), time()) for i in range(300)]
    rows += [(300, "tie", START), (301, "tie", START - timedelta(seconds=1)), (302, "later", START + timedelta(days=8))]
    got = as_of_join(
        spark.createDataFrame(rows, "id long, key string, at timestamp"),
        spark.createDataFrame(history, "key string, time timestamp, seq long, value string"),
        "key", "at", "time", ["value"], ["seq"], seconds,
    )
    assert sorted(map(tuple, got.select("id", "value").collect())) == _plain(rows, history)


def test_null_labels_of_the_newest_row_stay_null(spark):
    subscribers = spark.createDataFrame([("1", START, "old")], "customer_id string, at timestamp, sentiment string")
    schema = "customer_id string, raw_text string, feedback_category string, sentiment string, complaint_intensity int, created_at timestamp"
    feedback = spark.createDataFrame(
        [("1", "a", "pricing", "neutral", 1, START - timedelta(days=3)), ("1", None, None, None, None, START)], schema
    )
    row = enrich_as_of(subscribers, feedback, "at").first()
    assert (row["feedback_text"], row["sentiment"], row["complaint_intensity"]) == (None, None, None)
    none = enrich_as_of(subscribers, feedback.limit(0), "at").first()
    assert none["sentiment"] is None and enrich_as_of(subscribers.limit(0), feedback, "at").count() == 0


def test_a_key_is_dealt_out_over_its_stretches(spark):
    rows = spark.createDataFrame([("k", START)], "key string, at timestamp")
    history = spark.createDataFrame([("k", START, 1)], "key string, time timestamp, value long")
    plan = as_of_join(rows, history, "key", "at", "time", ["value"])._jdf.queryExecution().toString()
    assert "Window [last(_values" in plan and "_key" in plan and "_span" in plan
    assert plan.count("windowspecdefinition(_key#") >= 2
