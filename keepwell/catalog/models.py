"""Training, comparison and scoring queries, over one stored run of the full search per session and data set.

Training starts from subscribers with the labels that they had when their rows were drawn. A fourth of it, by stratified folds, is the holdout; the rest
trains. The run stores its models, trials, holdout scores and comparison, and every query reads them from there. What they
return is checked by a second way: the optimum by its gradient, probabilities and importances by the stored
trees' own rules, figures by the metric operators.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keepwell.catalog import query
from keepwell.catalog.features import enriched, enriched_then
from keepwell.catalog.views import with_views
from keepwell.operators import calibration, explain, features, metrics, rescoring, scoring
from keepwell.operators import models as ml
from keepwell.operators.bootstrap import champion_margin
from keepwell.operators.shaping import project_whitelist
from keepwell.plans import churn
from keepwell.plans.dashboards import churn as churn_dashboard
from keepwell.schemas import SUBSCRIBERS
from keepwell.session import materialize, scratch_path

VERSION = "champion_gbt"
_TREES = tuple(ml.SPACES)


@cache
def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(enriched_then(spark, sf_dir).select(*SUBSCRIBERS.fieldNames()), "enriched")
    folded = materialize(features.stratified_folds(rows, "churn", "customer_id", 4), "subscribers")
    return folded.filter("fold > 0").drop("fold"), folded.filter("fold = 0").drop("fold")


@cache
def stored_run(spark: SparkSession, sf_dir: str) -> str:
    """The folder of one full training run; its manifest is written last."""
    train, test = tables(spark, sf_dir)
    path, run = scratch_path(spark, "churn-run"), churn.train_churn(train, test)
    for name in run.trained.models:
        ml.save_pipeline(run.trained.pipeline(name), model_path(path, name))
    trials = [t.withColumn("model", F.lit(name)) for name, t in run.trained.trials.items()]
    reduce(DataFrame.unionByName, trials).write.parquet(f"{path}/trials")
    run.scores.write.parquet(f"{path}/scores")
    run.comparison.write.parquet(f"{path}/comparison")
    spark.createDataFrame([(run.champion,)], "champion string").write.parquet(f"{path}/manifest")
    return path


def model_path(run: str, name: str) -> str:
    return f"{run}/models/{name}"


def champion_path(spark: SparkSession, sf_dir: str) -> str:
    run = stored_run(spark, sf_dir)
    return model_path(run, spark.read.parquet(f"{run}/manifest").first()["champion"])


# --- second ways --------------------------------------------------------------------------------


def _nodes(spark: SparkSession, path: str) -> pd.DataFrame:
    """The nodes of a stored model's trees: at most 2 ** (depth + 1) for each of its rounds."""
    data = spark.read.parquet(f"{path}/model/stages/*/data")
    node = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    threshold = F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")
    counts = F.element_at("impurityStats", 1).alias("weight")
    return node.select(
        "treeID", "id", "prediction", "gain", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"),
        threshold, counts,
    ).toPandas()


def _weights(spark: SparkSession, path: str) -> dict[int, float]:
    stored = spark.read.parquet(f"{path}/model/stages/*/treesMetadata")  # number, description, weight
    return {row[0]: row[2] for row in stored.collect()}


def _by_rules(spark: SparkSession, path: str) -> Column:
    """The probability that a stored model's rules give for ``features``: down each tree, left up to the threshold."""
    nodes, weights = _nodes(spark, path), _weights(spark, path)
    trees = [(weights[t], part.sort_values("id").reset_index(drop=True)) for t, part in nodes.groupby("treeID")]
    plain = [(w, *(part[c].to_numpy() for c in ("feature", "threshold", "leftChild", "rightChild", "prediction"))) for w, part in trees]

    def walk(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), float)
        margin = np.zeros(len(x))
        for weight, feature, threshold, left, right, prediction in plain:
            at = np.zeros(len(x), int)
            while (inner := left[at] >= 0).any():
                down = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            margin += weight * prediction[at]
        return pd.Series(1 / (1 + np.exp(-2 * margin)))

    return F.pandas_udf(walk, "double")(vector_to_array(F.col("features")))


def _near(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance


def _scored(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """All subscribers with the probability of a stored model and, as ``_rules``, that by its rules."""
    model, rows = ml.load_pipeline(path), enriched(spark, sf_dir)
    scored = ml.prepare_rows(model.prepared, ml.score(model, rows)).withColumn("_rules", _by_rules(spark, path))
    return scored.drop("features")


_EACH = with_views("subscribers", "SELECT customer_id, true AS same FROM subscribers")


# --- queries ------------------------------------------------------------------------------------


# Features in the model's order.
_FEATURES = [c for c in SUBSCRIBERS.fieldNames() if c not in ("customer_id", "churn", "feedback_text")]
_FEATURE_ROWS = ", ".join(f"('{c}')" for c in _FEATURES)


@query("train_logreg", f"SELECT feature, true AS at_optimum FROM (VALUES {_FEATURE_ROWS}, ('(intercept)')) t(feature)")
def _(spark, sf_dir):
    """A second optimiser's step from the stored weights: the loss may not be a hundred-millionth above its least."""
    fitted = ml.load_pipeline(model_path(stored_run(spark, sf_dir), "logreg"))
    train = project_whitelist(tables(spark, sf_dir)[0])
    rows = ml.training_rows(fitted.prepared, train)
    gap, steps = ml.newton_gap(rows, fitted.model.coefficients.toArray().tolist(), fitted.model.intercept)
    table = [(name, gap <= 1e-8 and abs(step) < float("inf")) for name, step in zip([*fitted.prepared.names, "(intercept)"], steps)]
    return spark.createDataFrame(table, "feature string, at_optimum boolean")


def _trained(name):
    @query(f"train_{name}", _EACH)
    def _(spark, sf_dir):
        scored = _scored(spark, sf_dir, model_path(stored_run(spark, sf_dir), name))
        return scored.select("customer_id", _near(F.col("churn_probability"), F.col("_rules")).alias("same"))


for _name in _TREES:
    _trained(_name)


@query("cv_search", "SELECT model, 2::BIGINT AS candidates, 3::BIGINT AS folds, 6::BIGINT AS fits, true AS best_is_refitted FROM (VALUES "
       + ", ".join(f"('{name}')" for name in _TREES) + ") t(model)")
def _(spark, sf_dir):
    """How many fits a search took, and whether its refitted model has the parameters of the best mean area."""
    run = stored_run(spark, sf_dir)
    trials = spark.read.parquet(f"{run}/trials")
    refitted = []
    for name in _TREES:
        model = ml.load_pipeline(model_path(run, name)).model
        refitted.append((name, str({p: model.getOrDefault(p) for p in ml.SPACES[name]})))
    chosen = spark.createDataFrame(refitted, "model string, refitted string")
    means = trials.groupBy("model", "candidate", "params").agg(F.avg("auc").alias("mean"))
    best = means.groupBy("model").agg(F.max_by("params", F.struct("mean", -F.col("candidate"))).alias("best"))
    counts = trials.groupBy("model").agg(
        F.count_distinct("params").alias("candidates"), F.count_distinct("fold").alias("folds"), F.count("*").alias("fits")
    )
    same = (F.col("best") == F.col("refitted")).alias("best_is_refitted")
    return counts.join(best, "model").join(chosen, "model").select("model", "candidates", "folds", "fits", same)


_LINES = "(VALUES ('0'), ('1'), ('accuracy'), ('macro avg'), ('weighted avg'))"
_MODELS = "(VALUES " + ", ".join(f"('{name}')" for name in ("logreg", *_TREES)) + ")"


@query("model_comparison", f"""
SELECT model, class, true AS same_area, true AS same_figures FROM {_MODELS} m(model) CROSS JOIN {_LINES} l(class)""")
def _(spark, sf_dir):
    """The stored comparison against area and report computed from the stored holdout scores, row by row."""
    run = stored_run(spark, sf_dir)
    scores, stored = spark.read.parquet(f"{run}/scores"), spark.read.parquet(f"{run}/comparison")
    areas = metrics.roc_auc(scores, by=["model"]).select("model", "auc")
    figures = ["precision", "recall", "f1", "support"]
    again = metrics.classification_report(scores, by=["model"]).select("model", "class", *[F.col(c).alias(f"_{c}") for c in figures])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in figures])
    joined = stored.join(areas, "model").join(again, ["model", "class"])
    near = _near(F.bround("roc_auc", 6), F.col("auc"), 2e-6).alias("same_area")
    return joined.select("model", "class", near, same.alias("same_figures"))


@query("champion", f"SELECT 4::BIGINT AS models, '{ml.CHAMPION}' AS fixed_choice, true AS best_has_most")
def _(spark, sf_dir):
    run = stored_run(spark, sf_dir)
    stored = spark.read.parquet(f"{run}/comparison")
    best, fixed = ml.choose_champion(stored), spark.read.parquet(f"{run}/manifest").first()["champion"]
    areas = stored.select("model", "roc_auc").distinct()
    top = F.max(F.when(F.col("model") == best, F.col("roc_auc"))) == F.max("roc_auc")
    return areas.agg(F.count("*").alias("models"), F.lit(fixed).alias("fixed_choice"), top.alias("best_has_most"))


@query("batch_score", with_views("subscribers", "SELECT customer_id, true AS same, true AS level_follows FROM subscribers"))
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir, champion_path(spark, sf_dir))
    level = F.when(F.col("_rules") >= 0.4, "High").otherwise("Low")
    rows = scoring.with_risk(scored)
    same = _near(F.col("churn_probability"), F.bround("_rules", 4)).alias("same")
    follows = (F.col("churn_risk_level") == level) & (F.col("action_required") == (F.col("_rules") >= 0.4))
    return rows.select("customer_id", same, follows.alias("level_follows"))


@query("scored_dashboard", with_views("subscribers", """
SELECT count(*) AS total_customers, true AS same_mean, true AS same_high_risk FROM subscribers"""))
def _(spark, sf_dir):
    path = champion_path(spark, sf_dir)
    summary, _ = churn_dashboard(enriched(spark, sf_dir), ml.load_pipeline(path))
    again = _scored(spark, sf_dir, path).agg(
        F.bround(F.avg("_rules") * 100, 2).alias("mean"), F.count_if(F.col("_rules") >= 0.4).alias("high")
    )
    shown = F.rtrim("avg_churn_risk_percentage", F.lit("%")).cast("double")
    return summary.select(
        "total_customers",
        _near(shown, again.select("mean").scalar()).alias("same_mean"),
        (F.col("high_risk_customers") == again.select("high").scalar()).alias("same_high_risk"),
    )


@query("score_profile", with_views("subscribers", """
SELECT customer_id, true AS same, true AS risk_follows, state AS state_region FROM subscribers"""))
def _(spark, sf_dir):
    scored = _scored(spark, sf_dir, champion_path(spark, sf_dir))
    profiles = scoring.customer_profile(scored)
    rules = scored.select("customer_id", "_rules")
    joined = profiles.join(rules, "customer_id")
    follows = (F.col("risk_level") == "High") == (F.col("_rules") >= 0.4)
    same = _near(F.col("churn_probability"), F.bround("_rules", 4)).alias("same")
    return joined.select("customer_id", same, follows.alias("risk_follows"), "state_region")


# Scores of the model in memory against those of the same model read back.
@query("model_reload_score", _EACH)
def _(spark, sf_dir):
    kept, path = ml.load_pipeline(champion_path(spark, sf_dir)), scratch_path(spark, "saved-again")
    ml.save_pipeline(kept, path)
    rows = enriched(spark, sf_dir)
    again = ml.score(ml.load_pipeline(path), rows).select("customer_id", F.col("churn_probability").alias("reloaded"))
    both = ml.score(kept, rows).select("customer_id", "churn_probability").join(again, "customer_id")
    return both.select("customer_id", (F.col("churn_probability") == F.col("reloaded")).alias("same"))


@query("feature_importance", f"SELECT feature, true AS same FROM (VALUES {_FEATURE_ROWS}) t(feature)")
def _(spark, sf_dir):
    """Importance from the stored trees: gain times weight of a node, added up and made to sum to 1."""
    path = champion_path(spark, sf_dir)
    fitted, nodes = ml.load_pipeline(path), _nodes(spark, path)
    total = np.zeros(len(fitted.prepared.names))
    for _, part in nodes[nodes.leftChild >= 0].groupby("treeID"):
        own = np.bincount(part.feature, part.gain * part.weight, len(total))
        total += own
    share = total / total.sum() if total.sum() else total
    again = spark.createDataFrame(list(zip(fitted.prepared.names, map(float, share))), "feature string, again double")
    found = ml.feature_importance(spark, fitted.prepared, fitted.model)
    return found.join(again, "feature").select("feature", _near(F.col("importance"), F.col("again"), 1e-6).alias("same"))


@query("explain_scores", with_views("subscribers", """
SELECT customer_id, true AS adds_up, true AS same_score, n AS features FROM subscribers, (SELECT %d::BIGINT AS n)""" % len(_FEATURES)))
def _(spark, sf_dir):
    """Whether a customer's parts and the base add up to the margin, and the margin makes the stored rules' probability."""
    path = champion_path(spark, sf_dir)
    explained = explain.explain_scores(enriched(spark, sf_dir), path)
    total = F.aggregate("parts", F.col("base"), lambda a, b: a + b)
    rules = _scored(spark, sf_dir, path).select("customer_id", "_rules")
    return explained.join(rules, "customer_id").select(
        "customer_id", _near(total, F.col("margin")).alias("adds_up"),
        _near(1 / (1 + F.exp(-2 * F.col("margin"))), F.col("_rules")).alias("same_score"),
        F.size("parts").cast("bigint").alias("features"),
    )


@query("score_reasons", with_views("subscribers", """
SELECT customer_id, reason::INTEGER AS reason, true AS in_order, true AS known FROM subscribers CROSS JOIN (SELECT unnest([1, 2, 3]) AS reason)"""))
def _(spark, sf_dir):
    """The three features that move a customer's score most: of falling size, and each a feature of the model."""
    path = champion_path(spark, sf_dir)
    names = explain.explained_features(path)
    found = explain.reasons(explain.explain_scores(enriched(spark, sf_dir), path), names)
    before = F.lag(F.abs("part")).over(Window.partitionBy("customer_id").orderBy("reason"))
    in_order = F.coalesce(before >= F.abs("part"), F.lit(True)).alias("in_order")
    return found.select("customer_id", "reason", in_order, F.col("feature").isin(names).alias("known"))


@query("champion_margin", f"SELECT model, true AS same_area, true AS interval_holds, model <> '{ml.CHAMPION}' AS compared FROM {_MODELS} m(model)")
def _(spark, sf_dir):
    """The champion against each model on the stored holdout scores: areas by a second way, margins inside their intervals."""
    run = stored_run(spark, sf_dir)
    scores = spark.read.parquet(f"{run}/scores")
    champion = spark.read.parquet(f"{run}/manifest").first()["champion"]
    found = champion_margin(scores, champion)
    areas = metrics.roc_auc(scores, by=["model"]).select("model", F.col("auc").alias("_auc"))
    holds = (F.col("low") <= F.col("margin") + 0.02) & (F.col("high") >= F.col("margin") - 0.02) & (F.col("low") <= F.col("high"))
    return found.join(areas, "model").select(
        "model", _near(F.col("auc"), F.col("_auc"), 2e-6).alias("same_area"), holds.alias("interval_holds"), F.col("sure").isNotNull().alias("compared")
    )


@query("calibrated_scores", with_views("subscribers", """
SELECT customer_id, true AS is_share, true AS in_range FROM (
  SELECT customer_id, (row_number() OVER (PARTITION BY churn ORDER BY md5(customer_id), customer_id) - 1) % 4 AS fold FROM subscribers)
WHERE fold = 0"""))
def _(spark, sf_dir):
    """Calibrated on the stored holdout: rows of one calibrated probability have that share of positives."""
    run = stored_run(spark, sf_dir)
    champion = spark.read.parquet(f"{run}/manifest").first()["champion"]
    rows = spark.read.parquet(f"{run}/scores").filter(F.col("model") == champion)
    calibrated = calibration.fit_calibration(rows).apply(rows, "p")
    shares = calibrated.groupBy("calibrated_probability").agg(F.avg(F.col("y").cast("double")).alias("_share"))
    joined = calibrated.join(shares, "calibrated_probability")
    p = F.col("calibrated_probability")
    return joined.select("customer_id", _near(p, F.col("_share")).alias("is_share"), p.between(0, 1).alias("in_range"))


@query("rescore_changed", with_views("subscribers", """
SELECT customer_id, true AS same, CAST(customer_id AS INTEGER) % 7 = 0 AS rescored FROM subscribers"""))
def _(spark, sf_dir):
    """A seventh of the subscribers change after all were scored: only they are scored again, and the table is as if all were."""
    model, rows = ml.load_pipeline(champion_path(spark, sf_dir)), enriched(spark, sf_dir)
    log = materialize(rescoring.rescore_changed(rows, spark.createDataFrame([], rescoring.LOG), model, VERSION), "prediction-log")
    calls = F.col("customer_service_calls") + F.when(F.col("customer_id").cast("int") % 7 == 0, 1).otherwise(0)
    changed = rows.withColumn("customer_service_calls", calls.cast("int"))
    again = rescoring.rescore_changed(changed, log.drop("rescored"), model, VERSION)
    whole = ml.score(model, changed).select("customer_id", F.col("churn_probability").alias("_whole"))
    return again.join(whole, "customer_id").select("customer_id", (F.col("churn_probability") == F.col("_whole")).alias("same"), "rescored")
