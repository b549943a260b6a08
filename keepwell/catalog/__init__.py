"""The registered queries: each operator over the test tables, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from keepwell.session import prepare

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFunction
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(run: QueryFunction) -> QueryFunction:
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = Query(lambda spark, sf_dir: run(prepare(spark), sf_dir), sql)
        return run

    return register


def load_all() -> dict[str, Query]:
    from keepwell.catalog import (  # noqa: F401
        comments,
        features,
        metrics,
        models,
        reputation,
        scoring,
        streams,
        tables,
    )

    return REGISTRY
