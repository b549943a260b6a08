"""From subscriber rows to model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keepwell.operators.dedup import top_per_key
from keepwell.operators.ranking import hashed_position, position_in_group
from keepwell.schemas import CALL_PERIODS, existing
from keepwell.session import materialize

# Columns that are never features, and the text for a missing category.
NEVER_FEATURES = ("id", "customer_id", "created_at", "updated_at", "feedback_text", "raw_text")
MISSING = "Missing"
LABEL_NAMES = ("churn", "churn_flag")
LABEL_COLUMNS = ("feedback_category", "sentiment", "complaint_intensity")


def target_column(df: DataFrame) -> str | None:
    """``churn``, else ``churn_flag``, else none."""
    found = existing(df, LABEL_NAMES)
    return found[0] if found else None


def drop_non_features(df: DataFrame) -> DataFrame:
    target = target_column(df)
    return df.drop(*NEVER_FEATURES, *([target] if target else []))


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric (with booleans) and categorical feature columns, in table order."""
    fields = drop_non_features(df).schema.fields
    numeric = [f.name for f in fields if _is_number(f.dataType)]
    return numeric, [f.name for f in fields if not _is_number(f.dataType)]


def filled_number(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.col(name).cast("int"), F.lit(0)).alias(name)
    column = F.col(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        column = F.nanvl(column, F.lit(None).cast(dtype))
    return F.coalesce(column, F.lit(0).cast(dtype)).alias(name)


def filled_category(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): the position of each value among the sorted distinct ones.

    The distinct values are found in one pass for all columns; only they are sorted.
    """
    pairs = [F.struct(F.lit(c).alias("feature"), filled_category(c).alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    ranked = position_in_group(values, ["feature"], ["value"], "code")
    return ranked.select("feature", "value", F.col("code").cast("bigint").alias("code"))


def with_codes(
    df: DataFrame, codes: DataFrame, columns: Sequence[str], features: Sequence[str] | None = None
) -> DataFrame:
    """``df`` with categories replaced by their codes in a stored ``category_codes`` table.

    ``features`` names the columns in that table, where they are called otherwise. A value the table lacks gets the
    next code. Spark broadcasts the codes of a column where they are few and joins by shuffle where they are not.
    """
    sizes = {row["feature"]: row["n"] for row in codes.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    for name, feature in zip(columns, features or columns):
        own = codes.filter(F.col("feature") == feature)
        known = own.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        df = df.join(known, filled_category(name) == F.col("_value"), "left")
        df = df.withColumn(name, F.coalesce("_code", F.lit(sizes.get(feature, 0)).cast("bigint"))).drop("_value", "_code")
    return df


def feature_matrix(df: DataFrame, keep: Sequence[str] = (), is_inference: bool = False) -> DataFrame:
    """``keep`` columns, features in table order, and ``label`` where the table has one.

    Categories become codes fitted to this very table, missing numbers 0.
    Models use ``models.preprocessing`` instead, which is fitted once.
    """
    numeric, categorical = feature_columns(df)
    target = target_column(df)
    coded = df
    if categorical:
        df = materialize(df, "uncoded")  # codes and rows come from one evaluation
        coded = with_codes(df, materialize(category_codes(df, categorical), "category-codes"), categorical)
    features = [
        F.col(c) if c in categorical else filled_number(df, c) for c in drop_non_features(df).columns
    ]
    label = [F.col(target).alias("label")] if target and not is_inference else []
    return coded.select(*keep, *features, *label)


def class_weight(df: DataFrame, label: str = "churn") -> DataFrame:
    """Rows of each class, and the weight of a positive row: negatives per positive, 1 without positives."""
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )
    weight = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(1.0)
    return counts.withColumn("scale_pos_weight", weight)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3) -> DataFrame:
    """``df`` with ``fold`` 0..k-1: shuffled by a hash of ``key``, sizes equal within each class up to one row."""
    placed, position = hashed_position(df, label, key)
    return placed.withColumn("fold", F.pmod(position, F.lit(k)).cast("int")).select(*df.columns, "fold")


def usage_features(df: DataFrame) -> DataFrame:
    """Totals over all call periods and intensities per call, per minute and per unit of tenure."""

    def total(kind: str) -> Column:
        out = F.lit(0.0)
        for period in CALL_PERIODS:
            out = out + F.coalesce(F.col(f"total_{period}_{kind}").cast("double"), F.lit(0.0))
        return out

    tenure = F.col("account_length").cast("double")
    totals = df.withColumns({f"total_{kind}": total(kind) for kind in ("minutes", "calls", "charge")})
    return totals.withColumns(
        {
            "minutes_per_call": F.try_divide(F.col("total_minutes"), F.col("total_calls")),
            "charge_per_minute": F.try_divide(F.col("total_charge"), F.col("total_minutes")),
            "usage_intensity": F.try_divide(F.col("total_minutes"), tenure),
        }
    )


def latest_feedback(feedback: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """The newest feedback row of every customer by ``sequence``, whose last column is unique."""
    return top_per_key(feedback, ["customer_id"], [F.col(c).desc_nulls_last() for c in sequence])


def enrich_subscribers(subscribers: DataFrame, feedback: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Subscribers with the text and labels of their newest feedback by ``sequence``, null without any."""
    newest = latest_feedback(feedback, sequence).select(
        "customer_id", F.col("raw_text").alias("feedback_text"), *LABEL_COLUMNS
    )
    return subscribers.drop("feedback_text", *LABEL_COLUMNS).join(newest, "customer_id", "left")
