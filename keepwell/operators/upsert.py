"""Upserts as joins: results are new frames, to be written beside the old table.

The target is never sorted or ranked. Its side of each join needs only the
keys of the batch, so a batch small enough to broadcast leaves the target
unshuffled; larger ones fall back to a shuffled join on the key. Keys are compared
as the target's types, and two missing values are the same key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keepwell.operators.dedup import keep_first, keep_last
from keepwell.session import materialize


def _arrange(rows: DataFrame, target: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in target.schema
        ]
    )


def typed_keys(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch with its keys as the target's types, before anything is compared by them."""
    return batch.withColumns({k: F.col(k).cast(target.schema[k].dataType) for k in keys})


def _keys_of(rows: DataFrame, keys: Sequence[str], *more: str) -> tuple[DataFrame, Column]:
    """The keys under other names, and the condition that a row has the same."""
    renamed = rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *more)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return renamed, same


def merge_unique(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column] | None = None
) -> DataFrame:
    """Insert a batch that has every key once, replacing the target's rows with those keys.

    Columns the batch lacks keep their old value; new rows get ``defaults``. The batch is used more than
    once: pass a stored one.
    """
    keys, defaults = list(keys), defaults or {}
    kept_columns = [c for c in target.columns if c not in batch.columns]
    batch = typed_keys(batch, target, keys)
    changed, same = _keys_of(batch, keys)
    untouched = target.join(changed, same, "left_anti")
    if kept_columns:
        known = target.withColumn("_known", F.lit(True)).join(changed, same, "left_semi")
        old, same = _keys_of(known, keys, "_known", *kept_columns)
        batch = batch.join(old, same, "left").drop(*[f"_key_{k}" for k in keys])
        for name in kept_columns:
            if name in defaults:
                fresh = F.when(F.col("_known"), F.col(name)).otherwise(defaults[name])
                batch = batch.withColumn(name, fresh)
    return untouched.unionByName(_arrange(batch, target, defaults))


def bucketed_merge(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a target laid out by ``keys`` that a batch doesn't replace, and the batch; keys are not null.

    Keys are compared plainly, as the layout hashes them, so the target is joined where it lies.
    """
    return target.join(batch.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(batch)


def new_rows(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], defaults: Mapping[str, Column] | None = None
) -> DataFrame:
    """The rows, of a stored batch that has every key once, whose keys the target lacks."""
    keys = list(keys)
    batch = typed_keys(batch, target, keys)
    own, same = _keys_of(batch, keys)
    known, same_again = _keys_of(target.select(*keys).join(own, same, "left_semi"), keys)
    return _arrange(batch.join(known, same_again, "left_anti"), target, defaults or {})


def one_per_key(
    batch: DataFrame, target: DataFrame, keys: Sequence[str], sequence: Sequence[str], keep: str = "last"
) -> DataFrame:
    """The batch's last row of every key by ``sequence``, or the first; stored, as it is used more than once and
    its true size decides whether the target has to be shuffled."""
    choose = {"last": keep_last, "first": keep_first}[keep]
    return materialize(choose(typed_keys(batch, target, keys), keys, sequence), "batch")


def upsert_update(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
    keep: str = "last",
) -> DataFrame:
    """Insert the batch, replacing rows that have its keys.

    Of several batch rows with one key the last by ``sequence`` counts, or the first.
    """
    return merge_unique(target, one_per_key(batch, target, keys, sequence, keep), keys, defaults)


def upsert_ignore(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Insert the batch rows with new keys (the first row of each), leave known keys as they are."""
    return target.unionByName(new_rows(target, one_per_key(batch, target, keys, sequence, "first"), keys, defaults))
