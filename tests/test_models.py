"""Models on a table with a planted signal: customers who call support often leave."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.operators import features, metrics
from keepwell.operators import models as ml
from keepwell.operators.features import MISSING
from keepwell.plans import churn, dashboards
from keepwell.session import materialize

SCHEMA = "customer_id string, state string, account_length int, total_day_minutes double, customer_service_calls int, churn int"


def rows(n, seed):
    chance = random.Random(seed)
    out = []
    for i in range(n):
        calls = chance.randrange(8)
        leaves = chance.random() < 1 / (1 + math.exp(4 - 1.3 * calls))
        state = chance.choice(["B", "C", "A", None])
        minutes = chance.choice([None, chance.random() * 10])
        out.append((f"c{seed}_{i}", state, chance.randrange(100), minutes, calls, int(leaves)))
    return out


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(600, 1), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def test(spark):
    return spark.createDataFrame(rows(300, 2), SCHEMA).cache()


@pytest.fixture(scope="module")
def run(spark, train, test, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "champion")
    quick = {"maxIter": 4, "maxDepth": 3}
    found = churn.train_churn(train, test, model_path=path, n=2, folds=3, overrides=quick)
    return found, path


def test_signal_is_found(run):
    areas = {r.model: r.roc_auc for r in run[0].comparison.collect()}
    assert set(areas) == {"logreg", "gbt_a", "gbt_b", "gbt_c"}
    assert min(areas.values()) > 0.75


def test_comparison_matches_brute_force(run, test):
    scores = ml.holdout_scores(run[0].trained, test).toPandas()
    assert len(scores) == 4 * 300
    for row in run[0].comparison.collect():
        one = scores[scores.model == row.model]
        pos, neg = one.p[one.y == 1].to_numpy(), one.p[one.y == 0].to_numpy()
        won = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert row.roc_auc == pytest.approx(won / (len(pos) * len(neg)))
        if row["class"] == "1":
            said = one.p >= 0.4
            assert row.recall == pytest.approx((said & (one.y == 1)).sum() / (one.y == 1).sum(), abs=1e-4)


def test_champion(run):
    areas = {r.model: r.roc_auc for r in run[0].comparison.collect()}
    assert run[0].champion == "gbt_c"
    assert areas[ml.choose_champion(run[0].comparison)] == max(areas.values())


def test_trials(run):
    trials = run[0].trained.trials["gbt_a"].collect()
    assert sorted((t.candidate, t.fold) for t in trials) == [(c, f) for c in range(2) for f in range(3)]
    assert all(0.6 < t.auc <= 1 for t in trials)


def test_reloaded_model_scores_the_same(run, test):
    kept = {r.customer_id: r.churn_probability for r in ml.score(run[0].champion_model, test).collect()}
    again = {r.customer_id: r.churn_probability for r in ml.score(ml.load_pipeline(run[1]), test).collect()}
    assert kept == again and len(kept) == 300


def test_scoring_is_one_pass(run, test):
    plan = ml.score(run[0].champion_model, test)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan  # the codes are broadcast, being few


def test_importance(spark, run):
    trained = run[0].trained
    table = ml.feature_importance(spark, trained.prepared, trained.models["gbt_c"]).collect()
    assert table[0].feature == "customer_service_calls"
    assert sum(r.importance for r in table) == pytest.approx(1)
    assert ml.feature_importance(spark, trained.prepared, trained.models["logreg"]).count() == len(table) == 4


def encoded(prepared, df):
    names = prepared.names
    return [dict(zip(names, r.features.toArray())) for r in ml.prepare_rows(prepared, df).orderBy("customer_id").collect()]


def test_encoding_is_fitted_once(spark, train):
    prepared = ml.preprocessing(train)
    labels = ["A", "B", "C", MISSING]
    one = [(f"r{i}", s, 1, None, 2, 0) for i, s in enumerate(["C", None, "never seen", "A"])]
    got = encoded(prepared, spark.createDataFrame(one, SCHEMA))
    assert [g["state"] for g in got] == [labels.index("C"), labels.index(MISSING), len(labels), 0]
    assert got[0]["total_day_minutes"] == 0


def test_absent_columns_count_as_zero(spark, train):
    prepared = ml.preprocessing(train)
    bare = spark.createDataFrame([("a", 3)], "customer_id string, customer_service_calls int")
    out = ml.prepare_rows(prepared, bare)
    assert out.columns == ["customer_id", "customer_service_calls", "features"]
    assert encoded(prepared, bare) == [{"account_length": 0, "total_day_minutes": 0, "customer_service_calls": 3, "state": 0}]


def test_many_categories(spark):
    """More categories than tree bins."""
    df = spark.range(400).select(
        F.col("id").cast("string").alias("customer_id"), F.col("id").cast("string").alias("state"), (F.col("id") % 2).cast("int").alias("churn")
    )
    trained = ml.train_models(df, names=["gbt_c"], n=1, folds=2, overrides={"maxIter": 1, "maxDepth": 2})
    assert ml.score(trained.pipeline("gbt_c"), df).count() == 400


def test_null_labels_are_named(train):
    rows = train.withColumn("churn", F.when(F.col("customer_service_calls") != 3, F.col("churn")))
    with pytest.raises(ValueError, match="churn is null in"):
        ml.train_models(rows, names=["logreg"])


def test_training_rows_are_stored_by_fold(spark, train):
    folded = ml.folded_rows(ml.training_rows(ml.preprocessing(train), train))
    plan = folded.filter("fold <> 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and folded.count() == 600
    sizes = [r["count"] for r in folded.groupBy("fold", "label").count().collect()]
    assert len(sizes) == 6


def test_columns_with_stored_codes(spark, train):
    """The way for more categories: codes from a table, also for values it lacks."""
    codes = materialize(features.category_codes(train, ["state"]), "codes")
    fresh = spark.createDataFrame([("a", "C"), ("b", None), ("c", "Z")], "customer_id string, state string")
    got = {r.customer_id: r.state for r in features.with_codes(fresh, codes, ["state"]).collect()}
    assert got == {"a": 2, "b": 3, "c": 4}
    coded = features.with_codes(train, codes, ["state"])
    assert ml.feature_columns(coded)[1] == []
    model = ml.train_models(coded, names=["gbt_c"], n=1, folds=2, overrides={"maxIter": 1}).pipeline("gbt_c")
    assert ml.score(model, coded).count() == 600


def test_regression_reaches_the_penalised_optimum(train):
    prepared = ml.preprocessing(train)
    data = ml.training_rows(prepared, train)
    x = np.array([r.features.toArray() for r in data.collect()])
    y = np.array([r.label for r in data.collect()])
    model = ml.train_models(train, names=["logreg"]).models["logreg"]
    # gradient of: summed log loss + 0.5 * |w|^2
    w, b = model.coefficients.toArray(), model.intercept
    wrong = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ wrong + w).max() / len(y) < 1e-3
    assert abs(wrong.sum()) / len(y) < 1e-3


def test_weights(train):
    rows = ml.training_rows(ml.preprocessing(train), train).groupBy("label").agg(F.sum("weight").alias("w"))
    total = {r.label: r.w for r in rows.collect()}
    assert total[1.0] == pytest.approx(total[0.0])


def test_candidates():
    for space in ml.SPACES.values():
        picked = ml.sample_candidates(space)
        assert len(picked) == 2 and picked[0] != picked[1] and picked == ml.sample_candidates(space)
    assert len(ml.sample_candidates({"a": (1,)}, 5)) == 1


def test_empty_tables_are_errors(train, test):
    with pytest.raises(ValueError, match="training"):
        churn.train_churn(train.limit(0), test)
    with pytest.raises(ValueError, match="test table"):
        churn.train_churn(train, test.limit(0))


def test_dashboards(run, test):
    summary, top = dashboards.churn(test, run[0].champion_model)
    row = summary.first()
    assert row.total_customers == 300 and top.count() == 10
    scores = ml.score(run[0].champion_model, test)
    assert row.high_risk_customers == scores.filter("churn_probability >= 0.4").count()
    limited, _ = dashboards.churn(test, run[0].champion_model, limit=7)
    assert limited.first().total_customers == 7
    one = dashboards.profile(test, run[0].champion_model, "'c2_5' ").collect()
    assert [r.customer_id for r in one] == ["c2_5"]
    assert dashboards.profile(test, run[0].champion_model, "nobody").count() == 0


def test_audit_comes_with_a_run(run):
    got = {r.metric: r.value for r in run[0].audit.collect()}
    assert got["rows"] == 600 and got["missing_total"] > 0


def test_exact_area_of_a_model(run, test):
    scores = ml.holdout_scores(run[0].trained, test).filter("model = 'logreg'")
    exact = metrics.exact_area(scores)
    assert metrics.roc_auc(scores).first().auc == pytest.approx(exact, abs=0.002)


def test_a_regression_that_stopped_early_is_found_out(spark):
    rows = [(str(i), float(i % 13), float((i * i) % 101), "xyz"[i % 3], int(i % 13 + (i * i) % 101 / 9 + i % 5 > 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_id string, a double, b double, state string, churn int")
    prepared = ml.preprocessing(df)
    train = ml.training_rows(prepared, df).cache()
    learner = ml.logistic_regression(400)
    whole, early = learner.fit(train), learner.copy({learner.maxIter: 3}).fit(train)
    gaps = [ml.newton_gap(train, m.coefficients.toArray().tolist(), m.intercept)[0] for m in (whole, early)]
    assert 0 <= gaps[0] <= 1e-8 < gaps[1]
    wrong = whole.coefficients.toArray() + [0.1, 0, 0]
    gap, step = ml.newton_gap(train, wrong.tolist(), whole.intercept)
    assert gap > 1e-8 and step[0] > 0.05  # towards the optimum


def test_searches_share_their_fits(spark, train, monkeypatch):
    """Trials of a shorter learner come from the first trees of a longer one with equal parameters, and equal ones are fitted once."""
    lengths, whole = [], ml.boosted_trees

    class Counted:
        def __init__(self, learner):
            self.learner = learner

        def __getattr__(self, name):
            return getattr(self.learner, name)

        def fit(self, rows):
            lengths.append(self.learner.getMaxIter())
            return self.learner.fit(rows)

    monkeypatch.setattr(ml, "boosted_trees", lambda **params: Counted(whole(**params)))
    spaces = {"one": {"maxDepth": (3,), "maxIter": (2,)}, "two": {"maxDepth": (3,), "maxIter": (5,)}, "three": {"maxDepth": (3,), "maxIter": (5,)}}
    monkeypatch.setattr(ml, "SPACES", spaces)
    trained = ml.train_models(train, names=list(spaces), n=1, folds=2)
    assert sorted(lengths) == [2, 5, 5, 5]  # two folds for all three, a refit of each length
    trials = {name: [r.auc for r in trained.trials[name].orderBy("fold").collect()] for name in spaces}
    assert trials["two"] == trials["three"] and len(trials["one"]) == 2
    assert [len(trained.models[name].trees) for name in spaces] == [2, 5, 5]
    rows = ml.training_rows(trained.prepared, train)
    alone, longer = whole(maxDepth=3, maxIter=2).fit(rows), whole(maxDepth=3, maxIter=5).fit(rows)
    first = {r.customer_id: r.p for r in ml.first_trees_probability(longer, rows, 2).collect()}
    for r in alone.transform(rows).select("customer_id", ml.probability_column("p")).collect():
        assert first[r.customer_id] == pytest.approx(r.p, abs=1e-12)


def test_refits_use_all_parts(spark, train, monkeypatch):
    """Refits run last and few at a time: one is dealt to as many tasks as its rows have, not to a share of them."""
    parts, whole = [], ml.boosted_trees

    class Watched:
        def __init__(self, learner):
            self.learner = learner

        def __getattr__(self, name):
            return getattr(self.learner, name)

        def fit(self, rows):
            parts.append((rows.count(), rows.rdd.getNumPartitions()))
            return self.learner.fit(rows)

    monkeypatch.setattr(ml, "boosted_trees", lambda **params: Watched(whole(**params)))
    prepared = ml.preprocessing(train)
    rows = ml.training_rows(prepared, train)
    many, small = ml.folded_rows(rows, 3, per_partition=50), ml.folded_rows(rows, 3)
    for folded in (many, small):
        ml.random_search(folded, {"maxDepth": (2,), "maxIter": (2,)}, n=1)
    refits = [n for size, n in parts if size == 600]
    assert refits == [many.rdd.getNumPartitions(), 1] and refits[0] > 4
    assert all(n <= refits[0] // 2 for size, n in parts if size < 600)
