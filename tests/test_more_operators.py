"""Trends, drift, calibration, margins, lexicon joins and changes only, against plain versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.operators import bootstrap, calibration, drift, lexicon, metrics, rescoring
from keepwell.operators import labels as lb
from keepwell.operators import models as ml
from keepwell.operators import reputation as rep
from keepwell.operators.lexicon import lexicon_join

START = datetime.datetime(2024, 1, 1)


def test_the_trend_of_each_day_is_the_dashboard_of_that_day(spark):
    rng = random.Random(5)
    days = [d for d in range(40) if d not in (3, 11, 12, 25)]
    times = [START + datetime.timedelta(days=rng.choice(days), seconds=rng.randrange(86_400)) for _ in range(600)]
    rows = [(rng.choice(["positive", "Negative", "neutral", None]), t) for t in times]
    feedback = spark.createDataFrame(rows, "sentiment string, created_at timestamp")
    got = {r["date"]: r for r in rep.trend_over_time(feedback, F.lit(max(times))).collect()}
    assert set(got) == {t.strftime("%Y-%m-%d") for t in times}
    for date in list(got)[::5] + [max(got)]:
        until = max(t for t in times if t.strftime("%Y-%m-%d") == date)
        seen = feedback.filter(F.col("created_at") <= F.lit(until))
        want = rep.reputation_vs_last_week(seen, F.lit(until)).first()
        assert tuple(got[date])[2:] == tuple(want) and got[date]["total"] == seen.count()
    assert rep.trend_over_time(feedback.limit(0)).collect() == []


def _scores(n=900, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    good, bad = np.round(y * 0.4 + rng.random(n), 2), np.round(y * 0.05 + rng.random(n), 1)
    return [("good", f"c{i}", int(y[i]), float(good[i])) for i in range(n)] + [("bad", f"c{i}", int(y[i]), float(bad[i])) for i in range(n)]


def test_replicated_areas_are_those_of_drawn_tables(spark):
    rows = _scores(300)
    df = spark.createDataFrame(rows, "model string, customer_id string, y int, p double").repartition(7)
    areas = bootstrap.replicated_areas(df, 12)
    again = bootstrap.replicated_areas(df.repartition(3), 12)
    keys = {r[0]: r[1] for r in df.select("customer_id", F.xxhash64("customer_id")).distinct().collect()}
    for model in ("good", "bad"):
        own = [r for r in rows if r[0] == model]
        drawn = bootstrap.times_drawn(np.array([keys[r[1]] for r in own], np.int64), 12)
        y, p = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        wins = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        for b in range(12):
            pos, neg = drawn[:, b] * (y == 1), drawn[:, b] * (y == 0)
            assert areas[model][b] == pytest.approx(pos @ wins @ neg / (pos.sum() * neg.sum()))
        assert np.allclose(areas[model], again[model])
    exact = {r["model"]: r["auc"] for r in metrics.roc_auc(df, by=["model"]).collect()}
    assert all(abs(areas[m][0] - exact[m]) < 1e-6 for m in exact)


def test_draws_are_poisson():
    drawn = bootstrap.times_drawn(np.arange(20_000, dtype=np.int64), 21)
    assert (drawn[:, 0] == 1).all() and abs(drawn[:, 1:].mean() - 1) < 0.01 and abs(drawn[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(drawn[:, 1], drawn[:, 2])[0, 1]) < 0.03


def test_a_wrong_champion_is_found_out(spark):
    df = spark.createDataFrame(_scores(), "model string, customer_id string, y int, p double")
    right = {r["model"]: r for r in bootstrap.champion_margin(df, "good").collect()}
    wrong = {r["model"]: r for r in bootstrap.champion_margin(df, "bad").collect()}
    assert right["bad"]["sure"] > 0.99 and right["bad"]["low"] > 0 and right["good"]["sure"] is None
    assert wrong["good"]["sure"] < 0.01 and wrong["good"]["high"] < 0 and wrong["good"]["margin"] == -right["bad"]["margin"]
    with pytest.raises(ValueError):
        bootstrap.champion_margin(df, "none")
    one = df.withColumn("y", F.lit(1))
    assert {r["auc"] for r in bootstrap.champion_margin(one, "good").collect()} == {None}


def _pav(points):
    blocks = []
    for p, share, weight in sorted(points):
        blocks.append([share * weight, weight, [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, weight, own = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2] + own]
    return {p: total / weight for total, weight, own in blocks for p in own}


@pytest.mark.parametrize("parts", [1, 6])
def test_calibration_is_the_plain_pooling(spark, parts):
    rng = np.random.default_rng(9)
    p = np.round(rng.random(800) ** 2, 2)
    y = (rng.random(800) < 0.2 + 0.5 * p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int").repartition(parts)
    fitted = calibration.fit_calibration(df)
    got = {r["p"]: r["calibrated_probability"] for r in fitted.apply(df.select("p").distinct(), "p").collect()}
    want = _pav([(v, y[p == v].mean(), (p == v).sum()) for v in np.unique(p)])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    null = fitted.apply(spark.createDataFrame([(None,)], "p double"), "p").first()
    assert null["calibrated_probability"] is None
    table = calibration.reliability(fitted.apply(df, "p"), "calibrated_probability").collect()
    assert sum(r["n"] for r in table) == 800 and all(abs(r["mean_score"] - r["share"]) < 1e-9 for r in table)
    scored = df.withColumnRenamed("p", "churn_probability")
    risk = calibration.calibrated_scores(scored, fitted).collect()
    assert all(r["calibrated_risk"] == (r["calibrated_probability"] >= 0.4) for r in risk)
    with pytest.raises(ValueError):
        calibration.fit_calibration(df.limit(0))


def test_drift_from_stored_sketches(spark):
    rng = np.random.default_rng(2)
    rows = [(START.date() + datetime.timedelta(days=int(i % 20)), float(rng.normal(i % 20 >= 10, 1)), None if i % 7 else float("nan")) for i in range(8000)]
    df = spark.createDataFrame(rows, "day date, x double, nothing double")
    sketches = drift.daily_sketches(df, F.col("day"), ["x", "nothing"])
    assert sketches.count() == 40
    late = F.col("day") >= F.lit(START.date() + datetime.timedelta(days=10))
    got = {r["feature"]: r for r in drift.drift_between(sketches, ~late, late).collect()}
    one, two = (np.array([r[1] for r in rows if ((r[0] - START.date()).days >= 10) == side]) for side in (False, True))
    for name, values in (("deciles_before", one), ("deciles_after", two)):
        ranks = [(values <= q).mean() for q in got["x"][name]]
        assert np.allclose(ranks, drift.DECILES, atol=0.02)
    grid = np.sort(np.concatenate([one, two]))
    exact = max(abs((one <= v).mean() - (two <= v).mean()) for v in grid)
    assert abs(exact - got["x"]["distance"]) <= 0.04 and got["x"]["n_before"] == 4000
    assert got["nothing"]["distance"] is None and got["nothing"]["missing_after"] == 4000
    same = drift.drift_between(sketches, late, late).filter("feature = 'x'").first()
    assert same["distance"] == 0.0


TEXTS = [
    "Le prix est trop cher", "New York City is far", "new york", "york new", "I want to cancel, to cancel now", None, "", "...", "prix PRIX",
    "a b c d e f", "é È l'été",
]


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_lexicon_join(spark, threshold):
    entries = [
        ("new york city", "pricing", 2), ("New  York", "customer_support", 2), ("york", "churn_intent", 3), ("to cancel", "churn_intent", 1),
        ("cancel", "pricing", 1), ("prix", "pricing", 5), ("b c d", "customer_support", 4), ("c d e", "pricing", 4), ("!!", "pricing", 0),
        ("été", "churn_intent", 9), ("été", "pricing", 8),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        comments = spark.createDataFrame(list(enumerate(TEXTS)), "id int, raw_text string")
        lexicon = spark.createDataFrame(entries, "phrase string, category string, priority int")
        got = {r["id"]: (r["feedback_category"], r["matched_phrase"]) for r in lexicon_join(comments, lexicon, "id").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    default = ("service_quality", None)
    assert got == {
        0: ("pricing", "prix"), 1: ("customer_support", "new york"), 2: ("customer_support", "new york"), 3: ("churn_intent", "york"),
        4: ("pricing", "cancel"), 5: default, 6: default, 7: default, 8: ("pricing", "prix"), 9: ("customer_support", "b c d"), 10: ("pricing", "été"),
    }
    empty = lexicon_join(comments, lexicon.limit(0), "id").collect()
    assert {r["feedback_category"] for r in empty} == {"service_quality"} and len(empty) == len(TEXTS)


def test_lexicon_join_equals_the_word_list_on_whole_words(spark):
    rng = random.Random(1)
    single = {name: [w for w in found if w.isalpha()] for name, found in lb.LEXICON.items()}
    every = [w for found in single.values() for w in found]
    apart = [w for w in every if not any(w != o and o in w for o in every)]  # words that contain no other one
    texts = [(i, " ".join(rng.choices([*apart, "zq", "qz", "vv"], k=rng.randrange(0, 6)))) for i in range(200)]
    comments = spark.createDataFrame(texts, "id int, raw_text string")
    entries = [(w, name, lb.PRIORITY.index(name)) for name in single if name in lb.PRIORITY for w in single[name]]
    lexicon = spark.createDataFrame(entries, "phrase string, category string, priority int")
    want = {r["id"]: r["feedback_category"] for r in lb.lexicon_labels(comments, single).collect()}
    assert {r["id"]: r["feedback_category"] for r in lexicon_join(comments, lexicon, "id").collect()} == want and len(set(want.values())) > 1


def test_only_changed_rows_are_scored_again(spark):
    rows = [(str(i), "AB"[i % 2], i % 9, int(i % 9 > 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id string, state string, customer_service_calls int, churn int")
    prepared = ml.preprocessing(df)
    model = ml.ChurnModel(prepared, ml.boosted_trees(maxDepth=2, maxIter=2).fit(ml.training_rows(prepared, df)))
    empty = spark.createDataFrame([], rescoring.LOG)
    first = rescoring.rescore_changed(df, empty, model, "v1")
    log = spark.createDataFrame(first.drop("rescored").collect(), rescoring.LOG)
    assert first.filter("rescored").count() == 60 and rescoring.rescore_changed(df, log, model, "v1").filter("rescored").isEmpty()
    changed = df.withColumn("customer_service_calls", F.when(F.col("customer_id") == "3", 8).otherwise(F.col("customer_service_calls")))
    changed = changed.filter("customer_id <> '5'").unionByName(df.limit(1).withColumn("customer_id", F.lit(None).cast("string")))
    got = rescoring.rescore_changed(changed, log, model, "v1").collect()
    assert sorted(str(r["customer_id"]) for r in got if r["rescored"]) == ["3", "None"] and len(got) == 60
    whole = {r["customer_id"]: r["churn_probability"] for r in ml.score(model, changed).collect()}
    assert {r["customer_id"]: r["churn_probability"] for r in got} == whole
    assert rescoring.rescore_changed(df, log, model, "v2").filter("rescored").count() == 60


def test_of_a_large_lexicon_only_what_may_match_moves(spark, monkeypatch):
    chance = random.Random(7)
    texts = [(i, " ".join(chance.choice("abcdefgh") + str(chance.randrange(40)) for _ in range(chance.randrange(60)))) for i in range(150)]
    texts += [(150, None), (151, "")]
    comments = spark.createDataFrame(texts, "id int, raw_text string")
    entries = [(" ".join(chance.choice("abcdefgh") + str(chance.randrange(40)) for _ in range(n)), chance.choice("xyz"), chance.randrange(9)) for n in (1, 2, 2, 2, 3, 3) for _ in range(60)]
    table = spark.createDataFrame(entries, "phrase string, category string, priority int")

    def run():
        return {r["id"]: (r["feedback_category"], r["matched_phrase"]) for r in lexicon_join(comments, table, "id").collect()}

    whole = run()
    assert len(whole) == 152 and len({found for found in whole.values()}) > 20
    for small in (0, 60 * 28):  # nothing goes to every task, and the single words only
        monkeypatch.setattr(lexicon, "SMALL", small)
        assert run() == whole
    plan = lexicon_join(comments, table, "id")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan  # the bitmap is asked before anything is dealt by phrase
    known = table.select(F.col("phrase").alias("_phrase")).distinct()
    others = spark.range(20_000).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("_phrase"))
    bits = (16 * known.count()).bit_length()
    assert known.filter(lexicon.may_be_among(known, "_phrase", bits)).count() == known.count()
    assert others.filter(lexicon.may_be_among(known, "_phrase", bits)).count() < 1_000
