"""How sure it is that one model is better than another: paired Poisson bootstrap of the area under the ROC curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

STEP = np.uint64(0x9E3779B97F4A7C15)
#: The distribution function of a Poisson variable with mean 1.
POISSON = np.exp(-1.0) * np.cumsum(1 / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 17))]))

SUMS = "model string, at double, pos array<double>, neg array<double>, won array<double>"


def times_drawn(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each key is drawn in each replicate: Poisson numbers that depend on key and replicate alone. The first
    replicate is the table itself."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64)[:, None] + STEP * np.arange(1, replicates, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    drawn = np.searchsorted(POISSON, (mixed >> np.uint64(11)).astype(float) / 2.0**53, "right")
    return np.concatenate([np.ones((len(keys), 1)), drawn.astype(float)], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """For each model in a partition sorted by (model, p): its lowest score, and per replicate the drawn rows of both classes
    and the pairs of them, inside the partition, that the model orders rightly; ties count half."""
    names, found = ["model", "at", "pos", "neg", "won"], None
    zeros = np.zeros(replicates)

    def row() -> pa.RecordBatch:
        columns = [pa.array([found["model"]], pa.string()), pa.array([found["at"]], pa.float64())]
        columns += [pa.array([found[name]], pa.list_(pa.float64())) for name in names[2:]]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        models, p, y = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        drawn = times_drawn(batch.column(3).to_numpy(), replicates)
        change = np.flatnonzero([True] + [models[i] != models[i - 1] or p[i] != p[i - 1] for i in range(1, len(models))]) if models else []
        pos, neg = (np.add.reduceat(drawn * (y == c)[:, None], change) if len(change) else [] for c in (1, 0))
        for i, first in enumerate(np.asarray(change).tolist()):
            if found is None or found["model"] != models[first]:
                if found is not None:
                    yield row()
                found = {"model": models[first], "at": float(p[first]), "p": None, "pos": zeros, "neg": zeros, "won": zeros}
            if found["p"] != p[first]:
                found |= {"p": p[first], "pos_before": found["pos"], "neg_before": found["neg"], "pos_here": zeros, "neg_here": zeros}
                found["won_before"] = found["won"]
            found["pos_here"], found["neg_here"] = found["pos_here"] + pos[i], found["neg_here"] + neg[i]
            found["won"] = found["won_before"] + found["pos_here"] * (found["neg_before"] + found["neg_here"] / 2)
            found["pos"], found["neg"] = found["pos_before"] + found["pos_here"], found["neg_before"] + found["neg_here"]
    if found is not None:
        yield row()


def replicated_areas(scores: DataFrame, replicates: int = 200, key: str = "customer_id") -> dict[str, np.ndarray]:
    """The area under the ROC curve of each model in each replicate, from (model, ``key``, y, p); the first is that of the
    table itself. Models are compared on the same draws.

    Rows are sorted by model and score into ranges, once for all replicates. The driver adds up one row per range and model.
    """
    rows = scores.select("model", F.col("p").cast("double").alias("p"), F.col("y").cast("int").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("key"))
    placed = rows.repartitionByRange("model", "p").sortWithinPartitions("model", "p")
    parts = placed.mapInArrow(lambda batches: _sums(batches, replicates), SUMS).collect()
    areas = {}
    for model in sorted({r["model"] for r in parts}):
        pos, neg, won = (np.zeros(replicates) for _ in range(3))
        for r in sorted((r for r in parts if r["model"] == model), key=lambda r: r["at"]):
            won = won + np.array(r["won"]) + np.array(r["pos"]) * neg
            pos, neg = pos + np.array(r["pos"]), neg + np.array(r["neg"])
        with np.errstate(invalid="ignore", divide="ignore"):
            areas[model] = np.where(pos * neg > 0, won / (pos * neg), np.nan)
    return areas


def champion_margin(scores: DataFrame, champion: str, replicates: int = 200, level: float = 0.95, key: str = "customer_id") -> DataFrame:
    """``model``, ``auc``, ``margin`` (the champion's area less this one's), ``low`` and ``high`` (its interval at ``level``), and
    ``sure`` (the share of replicates in which the champion's is larger, ties half; null for itself)."""
    areas = replicated_areas(scores, replicates, key)
    if champion not in areas:
        raise ValueError(f"no scores of {champion}")
    tail, rows = (1 - level) / 2, []
    for model, own in areas.items():
        margins = areas[champion] - own
        drawn = margins[1:][~np.isnan(margins[1:])]
        low, high = (float(x) for x in np.quantile(drawn, [tail, 1 - tail])) if len(drawn) else (None, None)
        sure = float(np.mean((drawn > 0) + (drawn == 0) / 2)) if len(drawn) and model != champion else None
        rows.append((model, *(None if np.isnan(x) else float(x) for x in (own[0], margins[0])), low, high, sure))
    return scores.sparkSession.createDataFrame(rows, "model string, auc double, margin double, low double, high double, sure double")
