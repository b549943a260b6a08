"""Feedback labels: from a labeller's JSON answers, from keywords, or from a function of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keepwell.functions.text import strip
from keepwell.operators.comments import drop_blank
from keepwell.operators.shaping import ANONYMOUS, with_defaults

if TYPE_CHECKING:
    import pandas as pd

CATEGORIES = ("pricing", "service_quality", "customer_support", "churn_intent")
SENTIMENTS = ("positive", "neutral", "negative")

# The labels of a comment about which nothing else is known.
DEFAULT_LABELS = {"feedback_category": "service_quality", "sentiment": "neutral", "complaint_intensity": 1}

# The example words of the labelling rules, by category.
LEXICON = {
    "pricing": ("غالي", "بزاف", "ثمن", "فلوس"),
    "service_quality": ("واش غادي يلقاوهم", "زوين"),
    "customer_support": ("سيرفيس عيان", "ماجاوبونيش"),
    "churn_intent": ("غادي نلغي", "نبدل", "انوي", "اتصالات"),
}
# The gravest category wins where a text has words of several.
PRIORITY = ("churn_intent", "customer_support", "pricing", "service_quality")

_LABEL_TYPES = {"feedback_category": "string", "sentiment": "string", "complaint_intensity": "int"}


def comments_to_label(comments: DataFrame, order_id: str) -> DataFrame:
    """Comments with text, in the shape the label operators take: id, name and text never absent."""
    unknown = F.concat(F.lit("unknown_"), F.col(order_id).cast("string"))
    named = drop_blank(with_defaults(comments, {"customer_id": unknown, "username": ANONYMOUS}))
    return named.select(
        F.col(order_id),
        F.col("customer_id").cast("string").alias("customer_id"),
        strip(F.col("username")).alias("username"),
        F.col("text").alias("raw_text"),
    )


def _label(item: Column, name: str) -> Column:
    """The item's own label, also an explicit null; the default only where the key is absent."""
    own = F.try_variant_get(item, f"$.{name}", "variant")
    value = F.try_variant_get(item, f"$.{name}", _LABEL_TYPES[name])
    return F.when(own.isNull(), F.lit(DEFAULT_LABELS[name])).otherwise(value).alias(name)


def parse_labels(answers: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Label rows from JSON answers, and the quarantined answers with a reason.

    An answer is ``{"results": [{label: value, ...}, ...]}``; each object gives
    one row with the other columns of ``answers`` (they win over labels of the
    same name). Text that isn't JSON gives one row of default labels. JSON
    without ``results`` gives none. An answer of another shape is quarantined,
    from its first element that isn't an object on.
    """
    others = [c for c in answers.columns if c != answer]
    parsed = answers.select(*others, answer, F.try_parse_json(F.col(answer)).alias("_json"))
    shape = F.schema_of_variant(F.col("_json"))
    results = F.try_variant_get(F.col("_json"), "$.results", "variant")
    items = F.try_variant_get(F.col("_json"), "$.results", "array<variant>")
    not_object = F.transform(items, lambda item: ~F.startswith(F.schema_of_variant(item), F.lit("OBJECT")))
    checked = parsed.select(
        *others,
        answer,
        F.col("_json").isNull().alias("_malformed"),
        F.startswith(shape, F.lit("OBJECT")).alias("_object"),
        results.isNotNull().alias("_has_results"),
        items.alias("_items"),
        F.array_position(not_object, True).alias("_bad"),
    )

    good = F.when(F.col("_bad") > 0, F.slice(F.col("_items"), F.lit(1), (F.col("_bad") - 1).cast("int")))
    defaults = [F.lit(v).cast(_LABEL_TYPES[k]).alias(k) for k, v in DEFAULT_LABELS.items()]
    item_labels = F.transform(
        good.otherwise(F.col("_items")),
        lambda item: F.struct(*[_label(item, name) for name in DEFAULT_LABELS]),
    )
    labels = F.when(F.col("_malformed"), F.array(F.struct(*defaults))).otherwise(item_labels)
    rows = checked.select(*others, F.inline(labels))

    reason = (
        F.when(F.col("_malformed"), F.lit(None))
        .when(~F.col("_object"), F.lit("not an object"))
        .when(F.col("_has_results") & F.col("_items").isNull(), F.lit("results is not a list"))
        .when(F.col("_bad") > 0, F.concat(F.lit("not an object at "), F.col("_bad").cast("string")))
    )
    quarantine = checked.select(*others, answer, reason.alias("reason")).filter(F.col("reason").isNotNull())
    return rows, quarantine


def lexicon_category(
    text: Column, lexicon: Mapping[str, Sequence[str]] = LEXICON, priority: Sequence[str] = PRIORITY
) -> Column:
    """The first category in ``priority`` with a word in the text, else the default one."""
    folded = F.lower(text)
    hits = [
        F.when(_any([F.contains(folded, F.lit(word.lower())) for word in lexicon[name]]), F.lit(name))
        for name in priority
        if lexicon.get(name)
    ]
    return F.coalesce(*hits, F.lit(DEFAULT_LABELS["feedback_category"]))


def _any(conditions: Iterable[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def lexicon_labels(
    comments: DataFrame, lexicon: Mapping[str, Sequence[str]] = LEXICON, priority: Sequence[str] = PRIORITY
) -> DataFrame:
    """Labels from words in ``raw_text``. The word list is part of the plan, so nothing is joined or shuffled."""
    return comments.withColumns(
        {
            "feedback_category": lexicon_category(F.col("raw_text"), lexicon, priority),
            "sentiment": F.lit(DEFAULT_LABELS["sentiment"]),
            "complaint_intensity": F.lit(DEFAULT_LABELS["complaint_intensity"]),
        }
    )


def label_comments(
    comments: DataFrame, labeler: Callable[[pd.DataFrame], pd.DataFrame] | None = None
) -> DataFrame:
    """Labels from ``labeler``, which gets Arrow batches of ``comments`` as pandas frames.

    It returns the same rows with the three label columns added; rows that are lost, doubled, swapped or changed
    are an error. Without one, the keyword labels apply. Store the result before
    using it twice, or the labeller runs twice.
    """
    if labeler is None:
        return lexicon_labels(comments)
    added = [T.StructField("feedback_category", T.StringType()), T.StructField("sentiment", T.StringType())]
    schema = T.StructType([*comments.schema.fields, *added, T.StructField("complaint_intensity", T.IntegerType())])
    columns = schema.fieldNames()

    def label_batches(batches):
        for batch in batches:
            given = batch.copy()
            labelled = labeler(batch)[columns]
            if len(labelled) != len(given):
                raise ValueError(f"the labeller returned {len(labelled)} rows for {len(given)}")
            same = labelled[given.columns].reset_index(drop=True).astype(object)
            if not same.equals(given.reset_index(drop=True).astype(object)):
                raise ValueError("the labeller returned other rows than it was given")
            yield labelled

    return comments.mapInPandas(label_batches, schema)
