"""The training job: load, audit, encode, fit, compare, choose, persist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from keepwell.functions.risk import DEFAULT_THRESHOLD
from keepwell.operators import models as ml
from keepwell.operators.quality import data_audit
from keepwell.operators.shaping import project_whitelist
from keepwell.session import materialize
from keepwell.sources.readers import require_rows


@dataclass
class ChurnRun:
    trained: ml.Trained
    champion: str
    scores: DataFrame
    comparison: DataFrame
    audit: DataFrame

    @property
    def champion_model(self) -> ml.ChurnModel:
        return self.trained.pipeline(self.champion)


def train_churn(
    train: DataFrame,
    test: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    champion: str | None = ml.CHAMPION,
    model_path: str | None = None,
    names: Sequence[str] = ("logreg", *ml.SPACES),
    n: int = ml.CANDIDATES,
    folds: int = ml.FOLDS,
    overrides: Mapping[str, Any] | None = None,
) -> ChurnRun:
    """Fit on ``train``, compare on ``test``; ``champion=None`` takes the best instead of the fixed choice."""
    train = project_whitelist(require_rows(train, "the training table"))
    test = project_whitelist(require_rows(test, "the test table"))
    trained = ml.train_models(train, names=names, n=n, folds=folds, overrides=overrides)
    scores = materialize(ml.holdout_scores(trained, test), "holdout-scores")
    comparison = materialize(ml.compare_models(scores, names, threshold), "comparison")
    chosen = ml.choose_champion(comparison, champion)
    run = ChurnRun(trained, chosen, scores, comparison, data_audit(train))
    if model_path:
        ml.save_pipeline(run.champion_model, model_path)
    return run
