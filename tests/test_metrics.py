import random

import pytest
from pyspark.sql import functions as F

from keepwell.operators import metrics, scoring


def table(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y int, p double")


def pairs(n, seed, digits=2):
    chance = random.Random(seed)
    return [(chance.random() < 0.3 + 0.4 * (i % 2), round(chance.random() * 0.6 + 0.4 * (i % 2), digits)) for i in range(n)]


def auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc(spark, seed):
    rows = pairs(300, seed)
    assert metrics.roc_auc(table(spark, rows)).first().auc == pytest.approx(auc(rows), abs=1e-6)
    assert metrics.exact_area(table(spark, rows)) == pytest.approx(auc(rows))


def test_auc_ignores_monotone_changes(spark):
    rows = pairs(200, 7)
    bent = [(y, p * p) for y, p in rows]
    assert metrics.roc_auc(table(spark, rows)).first().auc == metrics.roc_auc(table(spark, bent)).first().auc


def test_scores_count_as_they_are(spark):
    rows = [(i % 2, 0.5 + (i % 2) * 1e-6 + i * 1e-10) for i in range(2000)]
    df = table(spark, rows)
    assert metrics.exact_area(df) == metrics.roc_auc(df).first().auc == 1.0
    assert metrics.roc_auc(df, digits=4).first().auc == 0.5
    assert metrics.best_threshold(df, 1.0).first().recall == 1.0


def test_one_class(spark):
    assert metrics.roc_auc(table(spark, [(1, 0.2), (1, 0.4)])).first().auc is None
    report = {r["class"]: r for r in metrics.classification_report(table(spark, [(1, 0.2)])).collect()}
    assert (report["0"].support, report["0"].recall, report["1"].recall, report["accuracy"].f1) == (0, 0.0, 0.0, 0.0)


def test_no_rows(spark):
    report = metrics.classification_report(table(spark, [])).collect()
    assert {r.support for r in report} == {0}


def prf(rows, threshold, positive):
    said = [(p >= threshold) == positive for _, p in rows]
    true = [bool(y) == positive for y, _ in rows]
    hit = sum(a and b for a, b in zip(said, true))
    precision = hit / sum(said) if sum(said) else 0.0
    recall = hit / sum(true) if sum(true) else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return precision, recall, f1, sum(true)


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.73, 2.0])
def test_report(spark, threshold):
    rows = pairs(150, 3)
    report = {r["class"]: r for r in metrics.classification_report(table(spark, rows), threshold).collect()}
    both = [prf(rows, threshold, False), prf(rows, threshold, True)]
    for name, want in zip("01", both):
        assert tuple(report[name])[1:] == pytest.approx(want, abs=1e-4)
    for i, field in enumerate(("precision", "recall", "f1")):
        assert report["macro avg"][field] == pytest.approx((both[0][i] + both[1][i]) / 2, abs=1e-4)
        mean = sum(b[i] * b[3] for b in both) / len(rows)
        assert report["weighted avg"][field] == pytest.approx(mean, abs=1e-4)
    right = sum((p >= threshold) == bool(y) for y, p in rows) / len(rows)
    assert report["accuracy"].f1 == pytest.approx(right, abs=1e-4)


def test_sweep_and_curve(spark):
    rows = pairs(120, 9)
    df = table(spark, rows)
    sweep = {r.threshold: r for r in metrics.threshold_sweep(df).collect()}
    assert sorted(sweep) == sorted({p for _, p in rows})
    for t, r in sweep.items():
        precision, recall, f1, _ = prf(rows, t, True)
        assert (r.precision, r.recall, r.f1) == pytest.approx((precision, recall, f1), abs=1e-6)
    for r in metrics.roc_pr_curve(df).collect():
        negatives = [p for y, p in rows if not y]
        assert r.fpr == pytest.approx(sum(p >= r.threshold for p in negatives) / len(negatives), abs=1e-6)
    best = metrics.best_threshold(df, 0.7).first()
    fitting = [(r.recall, t) for t, r in sweep.items() if r.precision >= 0.7]
    assert (best.recall, best.threshold) == max(fitting)


def test_groups(spark):
    a, b = pairs(80, 1), pairs(90, 2)
    both = table(spark, a).withColumn("model", F.lit("a")).union(table(spark, b).withColumn("model", F.lit("b")))
    got = {r.model: r.auc for r in metrics.roc_auc(both, by=["model"]).collect()}
    assert got == pytest.approx({"a": auc(a), "b": auc(b)}, abs=1e-6)


def test_many_scores_in_many_tasks(spark):
    df = spark.range(100_000).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.rand(1).alias("p"))
    steps = metrics.cumulative(df).toPandas().sort_values("threshold", ascending=False)
    assert len(steps) > 99_000
    assert (steps.tp == steps.pos.cumsum()).all() and (steps.fp == steps.neg.cumsum()).all()
    assert set(steps.positives) == {33334} and metrics.cumulative(df, digits=2).count() <= 101


def test_null_group(spark):
    rows = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.1), ("m", 1, 0.1)], "model string, y int, p double")
    got = {r.model: r.auc for r in metrics.roc_auc(rows, by=["model"]).collect()}
    assert got == {None: 1.0, "m": None}


# --- scoring ----------------------------------------------------------------------------------


def scored(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, churn_probability double")


def test_threshold_before_and_after_rounding(spark):
    """0.39996 is stored as 0.4: at risk by the stored value, not by the true one."""
    df = scored(spark, [("a", 0.39996), ("b", 0.4), ("c", 0.1)])
    assert scoring.churn_dashboard(df).first().high_risk_customers == 1
    top = {r.customer_id: r.risk_level for r in scoring.top_risk_profiles(df).collect()}
    assert top == {"a": "High", "b": "High", "c": "Low"}
    records = {r.customer_id: r for r in scoring.prediction_records(df, "v1").collect()}
    assert (records["a"].churn_probability, records["a"].churn_risk_level, records["a"].action_required) == (0.4, "Low", False)
    assert records["b"].model_version == "v1" and records["b"].predicted_at is not None


def test_dashboard(spark):
    row = scoring.churn_dashboard(scored(spark, [("a", 0.25), ("b", 0.5), ("c", 0.123)])).first()
    assert tuple(row) == (3, "29.1%", 1)
    assert scoring.churn_dashboard(scored(spark, [])).first().avg_churn_risk_percentage == "0%"


def test_top_profiles(spark):
    df = scored(spark, [(f"c{i:02}", (i % 12) / 20) for i in range(30)])
    got = [(r.customer_id, r.churn_probability) for r in scoring.top_risk_profiles(df).collect()]
    want = sorted(((f"c{i:02}", (i % 12) / 20) for i in range(30)), key=lambda x: (-x[1], x[0]))[:10]
    assert got == want
    first = scoring.top_risk_profiles(df).first()
    assert (first.state_region, first.tenure_months, first.sentiment_flag) == ("unknown", 0, "unknown")


def test_lookup(spark, tmp_path):
    path = str(tmp_path / "t")
    scored(spark, [("A1", 0.5), ("a1", 0.6)]).write.parquet(path)
    found = scoring.lookup_customer(spark.read.parquet(path), " 'A\"1' ")
    assert [r.customer_id for r in found.collect()] == ["A1"]
    assert "EqualTo(customer_id,A1)" in found._jdf.queryExecution().executedPlan().toString()


def test_high_risk(spark):
    subs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "customer_id string, state string")
    preds = scoring.prediction_records(scored(spark, [("a", 0.5), ("b", 0.9), ("c", 0.2), ("d", 0.95)]), "v")
    assert [r.customer_id for r in scoring.high_risk_customers(subs, preds).collect()] == ["b", "a"]


def test_intent(spark):
    df = scored(spark, [("a", 0.1), ("b", 0.1), ("c", 0.4), ("d", 0.1)]).withColumn(
        "feedback_category", F.when(F.col("customer_id") == "a", "churn_intent").when(F.col("customer_id") != "d", "pricing")
    )
    got = {r.customer_id: r.final_churn_risk_level for r in scoring.checked_predictions(df).collect()}
    assert got == {"a": "High", "b": "Low", "c": "High", "d": "Low"}
