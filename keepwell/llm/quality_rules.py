"""Quality rules: counts of words, symbols and repetition, and a hashed n-gram log-likelihood ratio between a trusted
target and the raw corpus. Only DataFrame functions.

A text's units are its runs of letters and digits and its runs of other signs; single units and pairs of neighbours
are hashed into a fixed number of buckets. A bucket's weight is the log of its smoothed share in the trusted texts over
that in all texts. A document's score is the mean weight of its n-grams, so length doesn't matter; it is kept if the
score reaches the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import SPACES, WORD, whole_text

UNIT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOL_RUNS = r"[^#*$%&|<>]+"
#: Buckets are added up as whole numbers of this part, so that sums don't depend on their order.
SCALE = 1_000_000


def grams(units: Column, buckets: int) -> Column:
    """The buckets of single units and of pairs of neighbours."""
    one = F.transform(units, lambda u: F.pmod(F.xxhash64(u), F.lit(buckets)).cast("int"))
    two = F.zip_with(
        F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0))),
        F.slice(units, 2, F.size(units)),
        lambda u, v: F.pmod(F.xxhash64(u, v), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids whose labels all say good."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("worst")).filter("worst = 1")
    return good.select("doc_id")


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int, smoothing: float) -> list[int]:
    """Per bucket the log ratio of its smoothed shares, in parts of ``SCALE``; all 0 without trusted texts.

    One pass over all documents, of which all trusted ones count for the target. Texts and trusted ids are both dealt by id at
    any size: each text moves once, so disk grows as the texts do, and no task holds all ids. The driver gets one row per bucket.
    """
    trusted = trusted_ids(labels).withColumn("trusted", F.lit(1))
    texts = docs.select("doc_id", whole_text().alias("text")).join(trusted.hint("merge"), "doc_id", "left")
    rows = texts.select("trusted", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    counts = (
        rows.select("trusted", F.explode(grams(F.col("units"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
        .collect()
    )
    raw, target = [smoothing] * buckets, [smoothing] * buckets
    for row in counts:
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if not any(row["target"] for row in counts):
        return [0] * buckets
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [round(SCALE * (math.log(t) - math.log(r) + shift)) for r, t in zip(raw, target)]


def repeated_words(words: Column, windows: Column, ordered: Column) -> Column:
    """How many words lie in windows that occur at least twice. ``ordered``: structs of hash and place, sorted."""

    def again(e: Column, k: Column) -> Column:
        neighbours = (F.get(ordered, k - 1)["hash"] == e["hash"], F.get(ordered, k + 1)["hash"] == e["hash"])
        return F.when(F.coalesce(neighbours[0], F.lit(False)) | F.coalesce(neighbours[1], F.lit(False)), e["at"])

    places = F.filter(F.transform(ordered, again), lambda at: at.isNotNull())
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda at: F.array(at, at + 1, at + 2)))))


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``units``."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    last = F.size("words") - 3
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.withColumn("windows", F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    rows = rows.withColumn("ordered", F.when(some, placed).otherwise(none))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(WORD)))
    rows = rows.withColumn("lines", lines)
    long = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.regexp_replace("text", f"[{SPACES}]+", "")),
        "n_symbols": F.length(F.regexp_replace("text", SYMBOL_RUNS, "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("words"), F.col("windows"), F.col("ordered")),
    }
    units = F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))
    return rows.select("doc_id", *[c.cast("bigint").alias(k) for k, c in long.items()], units.alias("units"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = -0.25,
    buckets: int = 1 << 14,
    smoothing: float = 1.0,
    least_words: int = 50,
    most_repeated: int = 50,
) -> DataFrame:
    """The verdict on each document: the counts of ``base_counts``, ``base_failed``, ``score`` and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` per cent of them in repeated windows of
    three. ``kept``: not so, and the score is ``threshold`` or more. The target is every text that ``labels`` calls
    good; the raw counts are of all documents. A null or empty text has no words, score null, and
    isn't kept. Without good labels all scores are 0. Repeated rows each give a row; no documents give none.
    """
    weights = bucket_weights(docs, labels, buckets, smoothing)
    constant = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    rows = base_counts(docs).withColumn("grams", grams(F.col("units"), buckets))
    total = F.aggregate("grams", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.get(constant, b))
    rows = rows.withColumn("score", F.try_divide(total, F.size("grams").cast("bigint") * F.lit(SCALE)))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return rows.drop("units", "grams").withColumn("kept", kept)


