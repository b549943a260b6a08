"""Scoring only what changed: a digest of the features beside each stored prediction."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from keepwell.operators.dedup import top_per_key
from keepwell.operators.models import ChurnModel, prepare_rows, probability_column
from keepwell.operators.scoring import PROBABILITY

LOG = f"customer_id string, {PROBABILITY} double, digest string, model_version string, predicted_at timestamp"


def with_digest(pipeline: ChurnModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``features`` and ``digest``, the SHA-256 of the numbers that the model would see."""
    prepared = prepare_rows(pipeline.prepared, rows)
    return prepared.withColumn("digest", F.sha2(F.to_json(vector_to_array("features")), 256))


def rescore_changed(rows: DataFrame, log: DataFrame, pipeline: ChurnModel, model_version: str, key: str = "customer_id") -> DataFrame:
    """The current prediction of every row: ``key``, probability (unrounded), ``digest``, ``model_version``, ``predicted_at`` and ``rescored``.

    ``log`` has such rows of earlier runs (schema ``LOG``). A row whose features have the digest of its newest log row, by the
    same model version, keeps that row; only others go through the model. Append those with ``rescored`` to the log.
    Customers that are gone are left out; a null ``key`` is always scored.
    """
    newest = top_per_key(log, [key], [F.col("predicted_at").desc_nulls_last(), F.col("digest")])
    known = newest.filter(F.col("model_version") == model_version).select(
        F.col(key).alias("_key"), F.col(PROBABILITY).alias("_probability"), F.col("digest").alias("_digest"), F.col("predicted_at").alias("_at")
    )
    digested = with_digest(pipeline, rows).select(key, "features", "digest")
    joined = digested.join(known, (F.col(key) == F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    kept = joined.filter("_key IS NOT NULL").select(
        key, F.col("_probability").alias(PROBABILITY), "digest", F.lit(model_version).alias("model_version"),
        F.col("_at").alias("predicted_at"), F.lit(False).alias("rescored"),
    )
    changed = pipeline.model.transform(joined.filter("_key IS NULL").select(key, "features", "digest"))
    scored = changed.select(
        key, probability_column(), "digest", F.lit(model_version).alias("model_version"),
        F.current_timestamp().alias("predicted_at"), F.lit(True).alias("rescored"),
    )
    return kept.unionByName(scored)
