import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepwell.operators import features, ranking
from keepwell.operators.quality import data_audit

SCHEMA = "customer_id string, plan string, flag boolean, calls int, minutes double, created_at timestamp, churn int"
ROWS = [
    ("1", "b", True, 1, 1.5, None, 1),
    ("2", None, None, None, math.nan, None, 0),
    ("3", "a", False, 3, None, None, 0),
    ("4", "Missing", True, 4, 2.5, None, 0),
    ("5", "é", True, 4, 2.5, None, 1),
    ("6", "Z", True, 4, 2.5, None, 0),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_matrix(table):
    got = {r.customer_id: r for r in features.feature_matrix(table, keep=["customer_id"]).collect()}
    values = sorted({r[1] or "Missing" for r in ROWS})
    for row in ROWS:
        out = got[row[0]]
        assert out.plan == values.index(row[1] or "Missing")
        assert out.flag == int(bool(row[2])) and out.calls == (row[3] or 0)
        assert out.minutes == (row[4] if row[4] and not math.isnan(row[4]) else 0.0)
        assert out.label == row[6]
    assert list(got["1"].asDict()) == ["customer_id", "plan", "flag", "calls", "minutes", "label"]


def test_matrix_for_inference_has_no_label(table):
    assert "label" not in features.feature_matrix(table, is_inference=True).columns


def test_target(table, spark):
    assert features.target_column(table) == "churn"
    assert features.target_column(table.withColumnRenamed("churn", "churn_flag")) == "churn_flag"
    assert features.target_column(table.drop("churn")) is None
    both = table.withColumn("churn_flag", F.lit(9))
    assert features.target_column(both) == "churn" and "churn_flag" in features.drop_non_features(both).columns


def test_column_of_nulls(spark):
    df = spark.createDataFrame([("1", None), ("2", None)], "customer_id string, plan string")
    assert {r.plan for r in features.feature_matrix(df, keep=["customer_id"]).collect()} == {0}


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_codes_of_many_values(spark, partitions):
    """Codes follow the order of all distinct values, however many partitions sort them."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(20_000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 5000).cast("string"))).alias("a"),
            F.when(F.col("id") % 2 == 0, F.md5(F.col("id").cast("string"))).alias("b"),
        )
        got = {(r.feature, r.value): r.code for r in features.category_codes(df, ["a", "b"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for name in ("a", "b"):
        values = sorted({r[0] or "Missing" for r in df.select(name).distinct().collect()})
        assert {v: i for i, v in enumerate(values)} == {v: c for (f, v), c in got.items() if f == name}


def test_matrix_with_a_large_code_table(spark, table):
    """Without broadcasts the codes are joined by a shuffle, with the same result."""
    want = sorted(map(tuple, features.feature_matrix(table, keep=["customer_id"]).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, features.feature_matrix(table, keep=["customer_id"]).collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds(spark, k):
    df = spark.range(4001).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 7 == 0).cast("int").alias("churn")
    )
    folded = features.stratified_folds(df, "churn", "customer_id", k).collect()
    sizes = Counter((r.churn, r.fold) for r in folded)
    for label in (0, 1):
        counts = [sizes[label, f] for f in range(k)]
        assert max(counts) - min(counts) <= 1
    assert len(folded) == 4001
    again = {r.customer_id: r.fold for r in features.stratified_folds(df.repartition(7), "churn", "customer_id", k).collect()}
    assert again == {r.customer_id: r.fold for r in folded}
    # shuffled: neighbours don't just alternate
    assert any(again[str(i)] == again[str(i + 7)] for i in range(0, 700, 7))


def test_folds_are_spread_over_tasks(spark):
    """A class is split into many window groups."""
    df = spark.range(10_000).select(F.col("id").alias("k"), F.lit(1).alias("y"))
    placed, position = ranking.hashed_position(df, "y", "k", per_bucket=10)
    groups = placed.groupBy("_bucket").count().agg(F.count("*"), F.max("count")).first()
    assert groups[0] > 3000 and groups[1] < 20
    assert sorted(r[0] for r in placed.select(position).collect()) == list(range(10_000))


def test_class_weight(spark):
    weight = lambda labels: features.class_weight(spark.createDataFrame([(x,) for x in labels], "churn int")).first()
    assert weight([1, 0, 0, 0, None]).scale_pos_weight == 3.0
    assert weight([0, 0]).scale_pos_weight == 1.0


def test_usage(spark):
    names = [f"total_{p}_{k}" for p in ("day", "eve", "night", "intl") for k in ("minutes", "calls", "charge")]
    row = {n: float(i) for i, n in enumerate(names)} | {"total_day_calls": None, "account_length": 0.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} double" for n in row))
    got = features.usage_features(df).first()
    assert (got.total_minutes, got.total_calls, got.total_charge) == (0 + 3 + 6 + 9, 4 + 7 + 10, 2 + 5 + 8 + 11)
    assert got.usage_intensity is None and got.minutes_per_call == 18 / 21


def test_enrich(spark):
    subs = spark.createDataFrame([("a", "old"), ("b", "old")], "customer_id string, sentiment string")
    feed = spark.createDataFrame(
        [("a", "t1", "pricing", "neutral", 1, 1), ("a", "t2", "churn_intent", "negative", 4, 2), ("a", "t0", "pricing", "positive", 2, None)],
        "customer_id string, raw_text string, feedback_category string, sentiment string, complaint_intensity int, created_at int",
    )
    got = {r.customer_id: r for r in features.enrich_subscribers(subs, feed, ["created_at", "raw_text"]).collect()}
    assert (got["a"].feedback_text, got["a"].sentiment, got["a"].complaint_intensity) == ("t2", "negative", 4)
    assert got["b"].sentiment is None


def test_audit(table):
    got = {r.metric: r.value for r in data_audit(table, watched=["plan", "minutes", "absent"]).collect()}
    assert got == {"rows": 6, "columns": 7, "missing_total": 1 + 1 + 1 + 2 + 6, "missing_plan": 1, "missing_minutes": 2}
