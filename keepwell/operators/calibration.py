"""Probabilities that mean what they say: isotonic calibration of a model's scores on a holdout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from keepwell.functions.risk import DEFAULT_THRESHOLD, at_risk
from keepwell.operators.scoring import PROBABILITY


@dataclass
class Calibration:
    """Pooled shares of positives by score, rising; between two of them a line."""

    model: IsotonicRegressionModel

    def apply(self, scored: DataFrame, column: str = PROBABILITY, name: str = "calibrated_probability") -> DataFrame:
        """``scored`` with the calibrated probability; a null score has a null one."""
        rows = scored.withColumn("_score", F.coalesce(F.col(column).cast("double"), F.lit(0.0)))
        found = self.model.transform(rows)
        return found.select(*scored.columns, F.when(F.col(column).isNotNull(), F.col("_calibrated")).alias(name))


def fit_calibration(holdout: DataFrame, by: str = "p", label: str = "y") -> Calibration:
    """From scores and 0/1 labels of rows that the model wasn't trained on.

    Equal scores are added up first, so that only distinct scores are sorted; Spark sorts them by range, pools adjacent
    violators inside each range, and then the pooled blocks. Rows without a score or label don't count.
    """
    counts = holdout.filter(F.col(by).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(by).cast("double").alias("_score")).agg(
        F.avg(F.col(label).cast("double")).alias("_share"), F.count("*").cast("double").alias("_weight")
    )
    if counts.isEmpty():
        raise ValueError("no labelled scores to calibrate on")
    learner = IsotonicRegression(featuresCol="_score", labelCol="_share", weightCol="_weight", predictionCol="_calibrated", isotonic=True)
    return Calibration(learner.fit(counts))


def calibrated_scores(scored: DataFrame, calibration: Calibration, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``scored`` with ``calibrated_probability`` and ``calibrated_risk``: whether it reaches the threshold."""
    rows = calibration.apply(scored)
    return rows.withColumn("calibrated_risk", at_risk(F.col("calibrated_probability"), threshold))


def reliability(rows: DataFrame, by: str, label: str = "y", bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share) by equal widths of the score: in a calibrated table the last two are near."""
    number = F.least(F.floor(F.col(by) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return rows.filter(F.col(by).isNotNull()).groupBy(number).agg(
        F.count("*").alias("n"), F.avg(by).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("share")
    )
