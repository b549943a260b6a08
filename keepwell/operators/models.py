"""Churn models: preprocessing fitted once, four learners, search, audit, choice, persistence, scoring."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import Executor, ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from threading import Lock
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keepwell.functions.risk import DEFAULT_THRESHOLD
from keepwell.operators.features import (
    category_codes,
    class_weight,
    feature_columns,
    stratified_folds,
    target_column,
    with_codes,
)
from keepwell.operators.metrics import classification_report, exact_area
from keepwell.operators.scoring import PROBABILITY
from keepwell.session import materialize, scratch_path

SEED = 42
FOLDS = 3
CANDIDATES = 2
FITS_AT_ONCE = 8  # the driver only steers them

# The search spaces of the three boosted-tree learners.
SPACES: Mapping[str, Mapping[str, Sequence[Any]]] = {
    "gbt_a": {"maxDepth": (3, 5, 6), "stepSize": (0.05, 0.1), "maxIter": (50, 100)},
    "gbt_b": {"maxDepth": (3, 5, 7), "stepSize": (0.05, 0.1), "maxIter": (50, 100)},
    "gbt_c": {"maxDepth": (4, 6), "stepSize": (0.05, 0.1), "maxIter": (100,)},
}
CHAMPION = "gbt_c"


@dataclass
class Prepared:
    """How raw columns become ``features``: fitted once on the training table, applied to every later one.

    Categories become their position among the training values, from the stored table ``codes``; a value not seen
    there gets the next number. Models take codes as plain numbers, so the number of categories isn't
    limited by tree bins, by the driver or by a task: a join looks them up, broadcast only where they are few.
    """

    numeric: list[str]
    categorical: list[str]
    codes: DataFrame | None

    @property
    def names(self) -> list[str]:
        """The training columns in the order of the feature vector."""
        return [*self.numeric, *self.categorical]


def preprocessing(df: DataFrame) -> Prepared:
    numeric, categorical = feature_columns(df)
    codes = materialize(category_codes(df, categorical), "category-codes") if categorical else None
    return Prepared(numeric, categorical, codes)


def prepare_rows(prepared: Prepared, df: DataFrame) -> DataFrame:
    """``df`` with ``features``. A training column it lacks counts as code or value 0; not-a-number as missing, 0."""
    have = set(df.columns)
    rows = df.withColumns({f"_code_{c}": F.col(c) for c in prepared.categorical if c in have})
    coded = [f"_code_{c}" for c in prepared.categorical if c in have]
    if coded:
        rows = with_codes(rows, prepared.codes, coded, [c.removeprefix("_code_") for c in coded])
    numbers = {}
    for c in prepared.numeric:
        own = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) if c in have else F.lit(0.0)
        numbers[f"_number_{c}"] = own
    for c in prepared.categorical:
        numbers[f"_number_{c}"] = F.col(f"_code_{c}").cast("double") if c in have else F.lit(0.0)
    assembler = VectorAssembler(inputCols=[f"_number_{c}" for c in prepared.names], outputCol="features")
    return assembler.transform(rows.withColumns(numbers)).select(*df.columns, "features")


def training_rows(prepared: Prepared, df: DataFrame, key: str = "customer_id") -> DataFrame:
    """(key, features, label, weight): positives weigh as many times as they are outnumbered."""
    label = target_column(df)
    if label is None:
        raise ValueError("no label column")
    unlabelled = df.filter(F.col(label).isNull()).count()
    if unlabelled:
        raise ValueError(f"{label} is null in {unlabelled} training rows")
    weight = class_weight(df, label).select("scale_pos_weight").scalar()
    target = F.col(label).cast("double")
    return prepare_rows(prepared, df).select(
        key, "features", target.alias("label"), F.when(target == 1, weight).otherwise(1.0).alias("weight")
    )


def logistic_regression(rows: int) -> LogisticRegression:
    """L2 with strength 1 on the summed loss, which is 1 / rows on the mean loss used here."""
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        maxIter=1000,
        regParam=1.0 / max(rows, 1),
        elasticNetParam=0.0,
        standardization=False,
    )


def newton_gap(rows: DataFrame, weights: Sequence[float], intercept: float) -> tuple[float, list[float]]:
    """How far a logistic regression's penalised mean loss is above its least, and the step of each weight (the intercept last)
    towards it, by a second optimiser: one Newton step from where it stopped.

    ``rows`` have ``features`` and ``label``. Each task adds up its gradient and curvature; the driver solves for the step.
    """
    w, d = np.append(np.array(weights, float), float(intercept)), len(weights) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, gradient, curvature = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1)
            x, y = np.hstack([x, np.ones((len(x), 1))]), batch.column(1).to_numpy()
            p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
            n, gradient, curvature = n + len(y), gradient + x.T @ (p - y), curvature + (x * (p * (1 - p))[:, None]).T @ x
        columns = [pa.array([n], pa.int64()), pa.array([gradient], pa.list_(pa.float64())), pa.array([curvature.ravel()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["n", "gradient", "curvature"])

    found = rows.select(vector_to_array("features").alias("x"), "label").mapInArrow(sums, "n long, gradient array<double>, curvature array<double>").collect()
    n = sum(r["n"] for r in found)
    if not n:
        return 0.0, [0.0] * d
    penalty = np.append(np.full(d - 1, 1.0 / n), 0.0)
    gradient = sum(np.array(r["gradient"]) for r in found) / n + penalty * w
    curvature = sum(np.array(r["curvature"]) for r in found).reshape(d, d) / n + np.diag(penalty)
    step = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
    return float(gradient @ step) / 2, step.tolist()


def boosted_trees(**params: Any) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=SEED, **params)


def sample_candidates(space: Mapping[str, Sequence[Any]], n: int = CANDIDATES, seed: int = SEED) -> list[dict]:
    """``n`` different points of the grid, always the same ones."""
    grid = [dict(zip(space, point)) for point in itertools.product(*space.values())]
    return random.Random(seed).sample(grid, min(n, len(grid)))


def probability_column(name: str = PROBABILITY, model: str = "probability"):
    return F.get(vector_to_array(F.col(model)), F.lit(1)).alias(name)


@dataclass
class Search:
    """The refitted best model, its parameters, and one (candidate, params, fold, auc) row per fit."""

    model: Any
    params: dict
    trials: DataFrame


def folded_rows(rows: DataFrame, folds: int = FOLDS, per_partition: int = 50_000) -> DataFrame:
    """``rows`` from ``training_rows``, stored once, in a folder per stratified fold: a fit reads the folds it trains on.

    Learners go through their rows many times, so a partition has some ten thousand of them, not a few.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "folds")
    folded = stratified_folds(rows, "label", rows.columns[0], folds)
    parts = max(1, math.ceil(rows.count() / per_partition))
    folded.repartition(parts).write.partitionBy("fold").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("fold", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def first_trees_probability(model: Any, rows: DataFrame, trees: int, name: str = "p") -> DataFrame:
    """``rows`` with ``name``, the probability that the first ``trees`` of boosted trees give: that of the learner stopped there."""
    margin = F.lit(0.0)
    for number, (tree, weight) in enumerate(zip(model.trees[:trees], model.treeWeights)):
        rows = tree.copy({tree.predictionCol: f"_tree_{number}"}).transform(rows)
        margin = margin + F.lit(float(weight)) * F.col(f"_tree_{number}")
    return rows.withColumn(name, 1 / (1 + F.exp(-2 * margin))).drop(*[f"_tree_{n}" for n in range(trees)])


class Fits:
    """Boosted trees on the folds of one table of ``folded_rows``, side by side in ``pool``; what several searches ask for is fitted once.

    Boosting adds trees one after another, so of learners that differ in ``maxIter`` alone the shorter one's trees are the first
    ones of the longer one's: one fit has the trials of both. Fits of many levels begin first, as the longest series of jobs.
    """

    def __init__(self, folded: DataFrame, candidates: Iterable[Mapping[str, Any]], folds: int, pool: Executor):
        self.folded, self.pool, self._refits, self._lock = folded, pool, {}, Lock()
        lengths: dict[tuple, set[int]] = {}
        for params in candidates:
            kind, length = self._split(params)
            lengths.setdefault(kind, set()).add(length)
        levels = {kind: max(own) * boosted_trees(**dict(kind)).getMaxDepth() for kind, own in lengths.items()}
        order = sorted(lengths, key=lambda kind: -levels[kind])
        self._areas = {(kind, fold): pool.submit(self._trial, kind, sorted(lengths[kind]), fold) for kind in order for fold in range(folds)}

    @staticmethod
    def _split(params: Mapping[str, Any]) -> tuple[tuple, int]:
        return tuple(sorted((k, v) for k, v in params.items() if k != "maxIter")), boosted_trees(**params).getMaxIter()

    def _trial(self, kind: tuple, lengths: Sequence[int], fold: int) -> dict[int, float]:
        fitted = boosted_trees(**dict(kind), maxIter=lengths[-1]).fit(_few_parts(self.folded.filter(F.col("fold") != fold)))
        held_out = self.folded.filter(F.col("fold") == fold).select("features", F.col("label").alias("y"))
        scored = {n: first_trees_probability(fitted, held_out, n) for n in lengths[:-1]}
        scored[lengths[-1]] = fitted.transform(held_out).withColumn("p", probability_column())
        return {n: exact_area(rows.select("p", "y")) for n, rows in scored.items()}

    def area(self, params: Mapping[str, Any], fold: int) -> float:
        """The ROC AUC on ``fold`` of the learner fitted on the others."""
        kind, length = self._split(params)
        return self._areas[kind, fold].result()[length]

    def refit(self, params: Mapping[str, Any]) -> Any:
        """The learner fitted on all rows."""
        with self._lock:
            kind = self._split(params)
            if kind not in self._refits:
                self._refits[kind] = self.pool.submit(lambda: boosted_trees(**params).fit(_all_parts(self.folded)))
        return self._refits[kind].result()


def search_candidates(space: Mapping[str, Sequence[Any]], n: int = CANDIDATES, overrides: Mapping[str, Any] | None = None) -> list[dict]:
    return [{**c, **(overrides or {})} for c in sample_candidates(space, n)]


def random_search(
    folded: DataFrame,
    space: Mapping[str, Sequence[Any]],
    n: int = CANDIDATES,
    folds: int = FOLDS,
    overrides: Mapping[str, Any] | None = None,
    fits: Fits | None = None,
) -> Search:
    """Stratified cross-validation of sampled candidates by ROC AUC; the best is refitted on all rows.

    ``folded`` come from ``folded_rows``. Each fit is a series of distributed jobs; the fits of all candidates and
    folds run side by side in those of ``fits``, which other searches share, or in some of their own.
    """
    candidates = search_candidates(space, n, overrides)
    with nullcontext() if fits else ThreadPoolExecutor(FITS_AT_ONCE) as threads:
        fits = fits or Fits(folded, candidates, folds, threads)
        trials = [(i, str(params), fold, fits.area(params, fold)) for i, params in enumerate(candidates) for fold in range(folds)]
        means = [sum(t[3] for t in trials if t[0] == i) / folds for i in range(len(candidates))]
        best = candidates[means.index(max(means))]
        model = fits.refit(best)
    table = folded.sparkSession.createDataFrame(trials, "candidate int, params string, fold int, auc double")
    return Search(model, best, table)


def _few_parts(rows: DataFrame) -> DataFrame:
    """The files of several folds in as many partitions as one has, at most one per file."""
    return rows.coalesce(max(1, rows.rdd.getNumPartitions() // FOLDS))


def _all_parts(folded: DataFrame) -> DataFrame:
    """All rows in as many partitions as Spark deals them to, but no more than files of one fold: for the refits, which
    come last and few at a time, so that each needs as many cores as its rows can use.
    """
    return folded.coalesce(max(1, len(folded.inputFiles()) // FOLDS))


@dataclass
class ChurnModel:
    """A fitted preprocessing and a model on its output: what is stored and what scores."""

    prepared: Prepared
    model: Any


@dataclass
class Trained:
    """One preprocessing and the models fitted on its output, by name."""

    prepared: Prepared
    models: dict[str, Any]
    trials: dict[str, DataFrame]

    def pipeline(self, name: str) -> ChurnModel:
        return ChurnModel(self.prepared, self.models[name])


def train_models(
    train: DataFrame,
    key: str = "customer_id",
    names: Sequence[str] = ("logreg", *SPACES),
    n: int = CANDIDATES,
    folds: int = FOLDS,
    overrides: Mapping[str, Any] | None = None,
) -> Trained:
    """Fit the named learners, side by side. ``overrides`` fix tree parameters, e.g. fewer iterations for a trial run."""
    train = materialize(train, "training-table")  # the joins behind it run once, whatever asks for its rows
    prepared = preprocessing(train)
    folded = folded_rows(materialize(training_rows(prepared, train, key), "training-rows"), folds)
    models, trials = {}, {}
    searched = [name for name in names if name != "logreg"]
    # searches wait for their fits, so they have threads of their own
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool, ThreadPoolExecutor(len(names) or 1) as searches:
        fits = Fits(folded, [c for name in searched for c in search_candidates(SPACES[name], n, overrides)], folds, pool)
        pending = {name: searches.submit(random_search, folded, SPACES[name], n, folds, overrides, fits) for name in searched}
        if "logreg" in names:
            models["logreg"] = logistic_regression(folded.count()).fit(_few_parts(folded))
        for name, search in pending.items():
            models[name], trials[name] = search.result().model, search.result().trials
    return Trained(prepared, {name: models[name] for name in names}, trials)


def score(pipeline: ChurnModel, df: DataFrame) -> DataFrame:
    """``df`` with ``churn_probability``: one pass; categories are joined, and shuffled only if they are very many."""
    scored = pipeline.model.transform(prepare_rows(pipeline.prepared, df))
    return scored.select(*df.columns, probability_column())


def holdout_scores(trained: Trained, holdout: DataFrame, key: str = "customer_id") -> DataFrame:
    """(model, key, y, p) of every model on the holdout. Features are computed once for all models."""
    label = target_column(holdout)
    rows = prepare_rows(trained.prepared, holdout).select(
        key, F.col(label).cast("int").alias("y"), "features"
    )
    for name, model in trained.models.items():
        scored = model.transform(rows)
        rows = scored.withColumn(f"_p_{name}", probability_column()).select(*rows.columns, f"_p_{name}")
    pairs = [F.struct(F.lit(n).alias("model"), F.col(f"_p_{n}").alias("p")) for n in trained.models]
    return rows.select(key, "y", F.inline(F.array(*pairs))).select("model", key, "y", "p")


def compare_models(scores: DataFrame, names: Sequence[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """(model, roc_auc, pr_auc) with the classification report of each model at the threshold."""
    counts = scores.groupBy("model", "y", "p").agg(F.count("*").alias("n"))
    counts = materialize(counts, "score-counts")  # the holdout is scored once for all figures
    areas = []
    for name in names:
        own = counts.filter(F.col("model") == name)
        areas.append((name, exact_area(own, "areaUnderROC", "n"), exact_area(own, "areaUnderPR", "n")))
    table = scores.sparkSession.createDataFrame(areas, "model string, roc_auc double, pr_auc double")
    report = classification_report(counts, threshold, ["model"], "n")
    return report.join(F.broadcast(table), "model")  # one row per model


def choose_champion(comparison: DataFrame, fixed: str | None = None) -> str:
    """The named model, or the one with the largest ROC AUC (first by name among equals)."""
    if fixed is not None:
        return fixed
    models = comparison.groupBy("model").agg(F.max("roc_auc").alias("roc_auc"))
    return models.orderBy(F.desc("roc_auc"), "model").first()["model"]


def feature_importance(spark: SparkSession, prepared: Prepared, model: Any) -> DataFrame:
    """(feature, importance), largest first: impurity gains of trees, absolute weights of a regression."""
    values = model.featureImportances if model.hasParam("maxDepth") else model.coefficients
    pairs = [(n, abs(float(v))) for n, v in zip(prepared.names, values.toArray())]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame(pairs, schema).orderBy(F.desc("importance"), "feature")


def save_pipeline(pipeline: ChurnModel, path: str) -> None:
    """The model, its columns and its category codes, below ``path``."""
    prepared, root = pipeline.prepared, path.rstrip("/")
    PipelineModel(stages=[pipeline.model]).write().overwrite().save(f"{root}/model")
    spark = SparkSession.active()
    columns = spark.createDataFrame([(prepared.numeric, prepared.categorical)], "numeric array<string>, categorical array<string>")
    columns.coalesce(1).write.mode("overwrite").parquet(f"{root}/columns")
    if prepared.codes is not None:
        prepared.codes.write.mode("overwrite").parquet(f"{root}/codes")


def load_pipeline(path: str) -> ChurnModel:
    spark, root = SparkSession.active(), path.rstrip("/")
    columns = spark.read.parquet(f"{root}/columns").first()
    codes = spark.read.parquet(f"{root}/codes") if columns["categorical"] else None
    prepared = Prepared(list(columns["numeric"]), list(columns["categorical"]), codes)
    return ChurnModel(prepared, PipelineModel.load(f"{root}/model").stages[0])
