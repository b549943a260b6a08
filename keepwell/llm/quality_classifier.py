"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class has a mean and a covariance of the statistics, the covariance shrunk towards a common multiple of the
identity. A score is the logistic function of the difference of the classes' log densities and log shares; the densities
come from Mahalanobis lengths by the inverse Cholesky factors, which are computed once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import resident
from keepwell.llm.scoring import with_scores

#: Kinds of bytes that are counted.
KINDS = {
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "symbol": [ord(c) for c in "#*$%&|<>@^~=+_/\\{}[]"],
    "stop": [ord(c) for c in ".,;:?-'\"()"],
    "shout": [ord("!")],
    "bar": [ord("|")],
    "beyond": range(0xC0, 0x100),
}
#: Shares of code points and words that a text of no length has; each text is as if it had ``EXTRA`` more
#: code points or ``EXTRA_WORDS`` more words like that, so that few words don't give extreme shares.
USUAL = {"upper": 0.03, "digit": 0.0, "symbol": 0.0, "stop": 0.03, "shout": 0.0, "bar": 0.0, "beyond": 0.02}
USUAL_WORDS = {"length": 5.0, "distinct": 1.0, "again": 0.0, "short": 0.4}
EXTRA, EXTRA_WORDS = 60, 12
STATISTICS = (*USUAL, *USUAL_WORDS, "repeated", "longest")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: square roots of shares and logs of lengths. No statistic tells a text's length as such."""
    n = len(offsets) - 1
    counts, words, lines = np.empty((n, 256), np.int64), np.zeros((n, 6)), np.zeros(n)
    whole = data.tobytes()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        counts[i] = np.bincount(data[a:b], minlength=256)
        text = whole[a:b]
        found = text.split()
        if found:
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            again = sum(map(bytes.__eq__, found[1:], found[:-1]))
            words[i] = len(found), sizes.sum(), len(set(found)), again, (sizes <= 3).sum(), sizes.max()
            filled = [line for line in text.split(b"\n") if line.strip()]
            lines[i] = 1 - (len(set(filled)) + 1) / (len(filled) + 1)
    size = counts.sum(1) - counts[:, 0x80:0xC0].sum(1)  # code points
    kinds = [counts[:, list(KINDS[name])].sum(1) for name in USUAL]
    shares = [np.sqrt((k + EXTRA * usual) / (size + EXTRA)) for k, usual in zip(kinds, USUAL.values())]
    per_word = [
        (words[:, k] + EXTRA_WORDS * usual) / (words[:, 0] + EXTRA_WORDS) for k, usual in enumerate(USUAL_WORDS.values(), 1)
    ]
    length, distinct, again, short = per_word
    columns = [*shares, np.log(length), distinct, np.sqrt(again), short, np.sqrt(lines), np.log(words[:, 5] + 10)]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Discriminant:
    """Per class: log share, mean, inverse Cholesky factor of the covariance and its log determinant."""

    shares: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for share, mean, factor, log_det in zip(self.shares, self.means, self.factors, self.log_dets):
            z = np.einsum("ij,kj->ik", x - mean, factor)  # row by row: equal texts get equal scores in any batch
            logs.append(np.log(share) - 0.5 * (log_det + np.einsum("ij,ij->i", z, z)))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, shrinkage: float) -> Discriminant | float:
    """The discriminant of the labelled documents whose ``doc_id`` satisfies ``train``; a class without any leaves
    the other's smoothed share as every score.

    Counts, sums and products of all labelled documents are added up by Spark; the driver gets one row per class.
    """
    wanted = labels.filter(train & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    d = len(STATISTICS)
    x = with_scores(docs, ["doc_id"], "x array<double>", _as_array)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.get("x", F.lit(i))) for i in range(d)]
    products = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i, j in pairs]
    rows = x.join(wanted, "doc_id").groupBy("label").agg(F.count("*"), *sums, *products).collect()
    found = {row[0]: (row[1], np.array(row[2 : 2 + d]), np.array(row[2 + d :])) for row in rows}
    n = [found[c][0] if c in found else 0 for c in (0, 1)]
    if 0 in n:
        return (n[1] + 1) / (sum(n) + 2)
    total = sum(found[c][1] for c in (0, 1)) / sum(n)
    spread = np.array([sum(found[c][2][pairs.index((i, i))] for c in (0, 1)) / sum(n) for i in range(d)]) - total**2
    scale = np.sqrt(np.maximum(spread, 0)) + 1e-6
    means, factors, log_dets = [], [], []
    for c in (0, 1):
        count, sum_, product = found[c]
        mean, second = sum_ / count, np.zeros((d, d))
        for (i, j), value in zip(pairs, product):
            second[i, j] = second[j, i] = value / count
        covariance = (second - np.outer(mean, mean)) / np.outer(scale, scale)
        part = shrinkage + (1 - shrinkage) * d / (count + d)  # few rows are shrunk more
        covariance = (1 - part) * covariance + part * max(np.trace(covariance) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(covariance)
        means.append(mean)
        factors.append(np.linalg.inv(lower) / scale)
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant((n[0] / sum(n), n[1] / sum(n)), np.array(means), np.array(factors), np.array(log_dets))


def _as_array(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
    resident("quality", dict)  # nothing of another operator's is kept from here on
    x = statistics(data, offsets)
    rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
    return {"x": rows}


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    keep: Sequence[str] = ("doc_id",),
    label: str = "quality",
    threshold: float = 0.3,
    shrinkage: float = 0.05,
) -> DataFrame:
    """The columns ``keep``, ``score`` (0 to 1, higher: ``label`` 1 likelier) and ``predicted`` (1 from ``threshold``).

    Only the text makes a score; labels are learned from rows of ``labels`` that satisfy ``train`` (several rows for a
    document count each, labels other than 0 and 1 don't). Null texts count as empty, and get the score of texts whose
    statistics are all 0. Without labels of both classes every score is the smoothed share of label 1. Every row of
    ``docs`` gives a row; none give none.
    """
    model = fit(docs, labels, label, train, shrinkage)

    def score(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        resident("quality", dict)
        if isinstance(model, float):
            scores = np.full(len(offsets) - 1, model)
        else:
            scores = model.scores(statistics(data, offsets))
        return {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))}

    return with_scores(docs, keep, "score double, predicted int", score)
