"""Classifier metric queries over fixed scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwell.catalog import query
from keepwell.catalog.views import scores, with_views
from keepwell.operators import metrics

_CELLS = """SELECT {by}count(CASE WHEN y <> 1 AND p < 0.4 THEN 1 END) AS tn,
  count(CASE WHEN y <> 1 AND p >= 0.4 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND p < 0.4 THEN 1 END) AS fn,
  count(CASE WHEN y = 1 AND p >= 0.4 THEN 1 END) AS tp FROM scores{group}"""


@query("confusion_matrix", with_views("scores", _CELLS.format(by="", group="")))
def _(spark, sf_dir):
    return metrics.confusion_matrix(scores(spark, sf_dir))


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0::DOUBLE)"


_REPORT = f"""
SELECT class, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS f1, support
FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, n1 FROM f
  UNION ALL SELECT 'accuracy', NULL, NULL, {_div('tn + tp', 'n0 + n1')}, n0 + n1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM f
  UNION ALL SELECT 'weighted avg', {_div('p0 * n0 + p1 * n1', 'n0 + n1')}, {_div('r0 * n0 + r1 * n1', 'n0 + n1')},
                   {_div('f0 * n0 + f1 * n1', 'n0 + n1')}, n0 + n1 FROM f)"""


@query("classification_report", with_views("scores", "SELECT 1").removesuffix("SELECT 1").rstrip() + f""",
cells AS ({_CELLS.format(by="", group="")}),
parts AS (SELECT *, {_div('tn', 'tn + fn')} AS p0, {_div('tn', 'tn + fp')} AS r0, {_div('tp', 'tp + fp')} AS p1,
                 {_div('tp', 'tp + fn')} AS r1, tn + fp AS n0, tp + fn AS n1 FROM cells),
f AS (SELECT *, {_div('2 * p0 * r0', 'p0 + r0')} AS f0, {_div('2 * p1 * r1', 'p1 + r1')} AS f1 FROM parts)
{_REPORT}""")
def _(spark, sf_dir):
    return metrics.classification_report(scores(spark, sf_dir))


_STEPS = """SELECT threshold, pos, neg, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
       CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives
FROM (SELECT p AS threshold, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y <> 1 THEN 1 END) AS neg
      FROM scores GROUP BY p)
WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)"""


# Twin by pairs of rows: a positive beats a negative, ties count half.
@query("roc_auc", with_views("scores", """
SELECT sum(p_pos) AS positives, sum(p_neg) AS negatives, round_even(sum(won) / (sum(p_pos) * sum(p_neg)), 6) AS auc
FROM (SELECT count(*) AS p_pos, 0 AS p_neg, 0 AS won FROM scores WHERE y = 1
      UNION ALL SELECT 0, count(*), 0 FROM scores WHERE y <> 1
      UNION ALL SELECT 0, 0, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END)
                FROM scores a JOIN scores b ON a.y = 1 AND b.y <> 1)""").replace(
    "sum(p_pos) AS positives, sum(p_neg) AS negatives",
    "CAST(sum(p_pos) AS BIGINT) AS positives, CAST(sum(p_neg) AS BIGINT) AS negatives"))
def _(spark, sf_dir):
    return metrics.roc_auc(scores(spark, sf_dir))


@query("threshold_sweep", with_views("scores", f"""
SELECT threshold, tp, fp, positives - tp AS fn, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even({_div('2 * precision * recall', 'precision + recall')}, 6) AS f1
FROM (SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'positives')} AS recall FROM ({_STEPS}))"""))
def _(spark, sf_dir):
    return metrics.threshold_sweep(scores(spark, sf_dir))


@query("best_threshold", with_views("scores", f"""
SELECT threshold, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even({_div('2 * precision * recall', 'precision + recall')}, 6) AS f1
FROM (SELECT *, {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'positives')} AS recall FROM ({_STEPS}))
WHERE round_even(precision, 6) >= 0.86 ORDER BY round_even(recall, 6) DESC, threshold DESC LIMIT 1"""))
def _(spark, sf_dir):
    return metrics.best_threshold(scores(spark, sf_dir), min_precision=0.86)


@query("roc_pr_curve", with_views("scores", f"""
SELECT threshold, round_even({_div('fp', 'negatives')}, 6) AS fpr, round_even({_div('tp', 'positives')}, 6) AS tpr,
       round_even({_div('tp', 'tp + fp')}, 6) AS precision FROM ({_STEPS})"""))
def _(spark, sf_dir):
    return metrics.roc_pr_curve(scores(spark, sf_dir))


# Two scorers in one table: the scores and their complement.
@query("confusion_matrix_by_model", with_views("scores", """
SELECT model, count(CASE WHEN y <> 1 AND p < 0.4 THEN 1 END) AS tn, count(CASE WHEN y <> 1 AND p >= 0.4 THEN 1 END) AS fp,
       count(CASE WHEN y = 1 AND p < 0.4 THEN 1 END) AS fn, count(CASE WHEN y = 1 AND p >= 0.4 THEN 1 END) AS tp
FROM (SELECT 'direct' AS model, y, p FROM scores UNION ALL SELECT 'reverse', y, round_even(1 - p, 4) FROM scores)
GROUP BY model"""))
def _(spark, sf_dir):
    rows = scores(spark, sf_dir)
    models = F.array(
        F.struct(F.lit("direct").alias("model"), F.col("p").alias("q")),
        F.struct(F.lit("reverse").alias("model"), F.bround(1 - F.col("p"), 4).alias("q")),
    )
    both = rows.select("y", F.inline(models)).withColumnRenamed("q", "p")
    return metrics.confusion_matrix(both, by=["model"])
