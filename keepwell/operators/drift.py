"""Drift of features and scores between days, from quantile sketches that are stored per day and merged without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Accuracy of the sketches: with 400 the rank of a value is off by about 0.7 per cent, by a per cent and a half hardly ever.
ACCURACY = 400
PERCENTILES = tuple(i / 100 for i in range(1, 100))
DECILES = PERCENTILES[9::10]


def daily_sketches(df: DataFrame, day: Column, columns: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """(day, feature, n, missing, sketch) of numeric columns: one pass, one small row per day and feature.

    Spark merges the sketches of the parts of a day, so a day of any size is no hot group. Missing values and not-a-numbers
    are counted apart. Append the rows of a new day to those of the days before.
    """
    values = [F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value")) for c in columns]
    rows = df.select(day.alias("day"), F.inline(F.array(*values)))
    return rows.groupBy("day", "feature").agg(
        F.count("value").alias("n"), (F.count("*") - F.count("value")).alias("missing"), F.kll_sketch_agg_double("value", accuracy).alias("sketch")
    )


def merged(sketches: DataFrame, condition: Column) -> DataFrame:
    """(feature, n, missing, sketch) of the days that satisfy the condition."""
    return (
        sketches.filter(condition)
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.kll_merge_agg_double("sketch").alias("sketch"))
    )


def drift_between(sketches: DataFrame, before: Column, after: Column) -> DataFrame:
    """(feature, n_before, n_after, missing_before, missing_after, deciles_before, deciles_after, distance) of two sets of days.

    ``distance``, from 0 to 1, is the largest difference of the two distribution functions as their percentiles have them:
    the Kolmogorov-Smirnov distance but for two hundredths and the sketches' error. A feature without values on one side has null
    deciles there and a null distance.
    """
    wanted, sides = F.array(*[F.lit(q) for q in PERCENTILES]), []
    for name, condition in (("before", before), ("after", after)):
        found = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", wanted))
        deciles = F.filter(found, lambda _, i: (i + 1) % 10 == 0)
        sides.append(merged(sketches, condition).select(
            "feature", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "missing")], found.alias(f"_{name}"), deciles.alias(f"deciles_{name}")
        ))

    def below(side: str, value: Column) -> Column:
        return F.size(F.filter(F.col(f"_{side}"), lambda q: q <= value))

    gaps = F.transform(F.concat("_before", "_after"), lambda v: F.abs(below("before", v) - below("after", v)) / float(len(PERCENTILES)))
    return sides[0].join(sides[1], "feature", "full").withColumn("distance", F.array_max(gaps)).drop("_before", "_after")
