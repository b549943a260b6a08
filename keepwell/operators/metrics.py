"""Classifier metrics over rows of (optional group columns, y, p).

Everything that needs an order works on counts per distinct score, sorted by
range: each partition adds up its own, and the sums of the partitions before it
give where it starts. So scores are ranked as they are, however many there are.
With ``digits`` they are rounded first, which is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keepwell.functions.numbers import ratio
from keepwell.functions.risk import DEFAULT_THRESHOLD
from keepwell.operators.ranking import partition_of
from keepwell.session import materialize


def confusion_matrix(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Rows per cell; with ``weight``, a column of counts, each row stands for that many."""
    said, is_true = F.col("p") >= F.lit(threshold), F.col("y") == 1

    def cell(condition: Column) -> Column:
        if weight is None:
            return F.count_if(condition)
        return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))

    return df.groupBy(*by).agg(
        cell(~is_true & ~said).alias("tn"),
        cell(~is_true & said).alias("fp"),
        cell(is_true & ~said).alias("fn"),
        cell(is_true & said).alias("tp"),
    )


def _scores(right: Column, said: Column, true: Column) -> tuple[Column, Column, Column]:
    precision, recall = ratio(right, said), ratio(right, true)
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def classification_report(
    df: DataFrame, threshold: float = DEFAULT_THRESHOLD, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Per class, overall and averaged precision, recall, F1 and support, to four decimals.

    The accuracy line has its value under ``f1``.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, tp + fn
    p0, r0, f0 = _scores(tn, tn + fn, n0)
    p1, r1, f1 = _scores(tp, tp + fp, n1)

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * n0 + b * n1, n0 + n1)

    nothing = F.lit(None).cast("double")
    lines = [
        ("0", p0, r0, f0, n0),
        ("1", p1, r1, f1, n1),
        ("accuracy", nothing, nothing, ratio(tn + tp, n0 + n1), n0 + n1),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1),
        ("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n0 + n1),
    ]
    report = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"),
                F.bround(precision, 4).alias("precision"),
                F.bround(recall, 4).alias("recall"),
                F.bround(f1_score, 4).alias("f1"),
                support.alias("support"),
            )
            for name, precision, recall, f1_score, support in lines
        ]
    )
    return confusion_matrix(df, threshold, by, weight).select(*by, F.inline(report))


def score_histogram(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    score = F.col("p") if digits is None else F.bround("p", digits)
    return df.groupBy(*by, score.alias("threshold")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )


def cumulative(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Per distinct score: rows at or above it (tp, fp) and all rows of each class."""
    counts = score_histogram(df, by, digits)
    numbered = counts.orderBy(*by, F.desc("threshold")).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(numbered, "score-counts").withColumn("_part", partition_of("_id"))
    # one row per group and sort partition
    parts = stored.groupBy(*by, "_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_pos").over(before), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("_neg").over(before), F.lit(0)).alias("_fp"),
        F.sum("_pos").over(group).alias("positives"),
        F.sum("_neg").over(group).alias("negatives"),
    )
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = Window.partitionBy(*by, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stored.withColumns({"tp": F.sum("pos").over(own), "fp": F.sum("neg").over(own)})
    placed = sums.join(starts, same).withColumns({"tp": F.col("tp") + F.col("_tp"), "fp": F.col("fp") + F.col("_fp")})
    return placed.select(*by, "threshold", "pos", "neg", "tp", "fp", "positives", "negatives")


def roc_auc(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; null if a class is missing."""
    steps = cumulative(df, by, digits)
    won = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    return steps.groupBy(*by).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        won.alias("_won"),
    ).select(
        *by,
        "positives",
        "negatives",
        F.bround(
            F.try_divide(F.col("_won"), F.col("positives").cast("double") * F.col("negatives")), 6
        ).alias("auc"),
    )


def threshold_sweep(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Precision, recall and F1 of flagging everything from each score upward."""
    precision, recall, f1 = _scores(F.col("tp"), F.col("tp") + F.col("fp"), F.col("positives"))
    return cumulative(df, by, digits).select(
        *by,
        "threshold",
        "tp",
        "fp",
        (F.col("positives") - F.col("tp")).alias("fn"),
        F.bround(precision, 6).alias("precision"),
        F.bround(recall, 6).alias("recall"),
        F.bround(f1, 6).alias("f1"),
    )


def best_threshold(
    df: DataFrame, min_precision: float = 0.0, by: Sequence[str] = (), digits: int | None = None
) -> DataFrame:
    """The threshold with most recall among those precise enough; the highest such threshold."""
    good = threshold_sweep(df, by, digits).filter(F.col("precision") >= min_precision)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("recall", "threshold"))
    return good.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")


def roc_pr_curve(df: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Points of the ROC and precision-recall curves."""
    return cumulative(df, by, digits).select(
        *by,
        "threshold",
        F.bround(ratio(F.col("fp"), F.col("negatives")), 6).alias("fpr"),
        F.bround(ratio(F.col("tp"), F.col("positives")), 6).alias("tpr"),
        F.bround(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
    )


def exact_area(df: DataFrame, metric: str = "areaUnderROC", weight: str | None = None) -> float:
    """Area under the ROC (or, ``areaUnderPR``, precision-recall) curve over unrounded scores.

    Equal scores are counted before they are sorted; with ``weight``, they have been.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    p, y = F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("y")
    if weight is None:
        counts = df.groupBy(p, y).agg(F.count("*").cast("double").alias("n"))
    else:
        counts = df.select(p, y, F.col(weight).cast("double").alias("n"))
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="p", labelCol="y", weightCol="n", metricName=metric, numBins=0
    )
    return float(evaluator.evaluate(counts))
