"""Labels from a stored lexicon of phrases, however many: word sequences of the texts are joined with it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from keepwell.operators.labels import DEFAULT_LABELS
from keepwell.session import materialize

WORD = r"[\p{L}\p{N}]+"
SMALL = 8 << 20  # bytes of phrases that Spark may send to every task
MOST_BITS = 27  # of a bitmap, by their logarithm: 16 MB


def words(text: Column) -> Column:
    """The lower-cased words of a text, runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrases(text: Column, lengths: list[int]) -> Column:
    """The distinct sequences of as many words as any of ``lengths`` says, joined by spaces."""

    def of(own: Column, n: int) -> Column:
        starts = F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " "))

    every = F.transform(F.array(words(text)), lambda own: F.array_distinct(F.flatten(F.array(*[of(own, n) for n in lengths]))))
    return F.get(every, F.lit(0))


def _places(phrase: Column, bits: int) -> list[Column]:
    """Two bits of a phrase in a bitmap of 2 ** ``bits``."""
    digest = F.xxhash64(phrase)
    return [F.pmod(h, F.lit(1 << bits)) for h in (digest, F.shiftrightunsigned(digest, 32))]


def may_be_among(known: DataFrame, phrase: str, bits: int) -> Column:
    """Whether ``phrase`` may be one of ``known`` (_phrase): always for one that is, rarely for another, by a bitmap of hashes."""
    at = known.select(F.explode(F.array(*_places(F.col("_phrase"), bits))).alias("at")).selectExpr("at + 1 AS at")  # bitmaps count from 1
    built = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
    bitmap = np.zeros(max((1 << bits) // 8, 1 << 12), np.uint8)
    for row in built.toLocalIterator():
        own, first = np.frombuffer(bytes(row["bitmap"]), np.uint8), (row["bucket"] - 1) << 12
        bitmap[first : first + len(own)] = own
    sent = known.sparkSession.sparkContext.broadcast(bitmap)

    def found(one: pd.Series, two: pd.Series) -> pd.Series:
        a, b = one.to_numpy(), two.to_numpy()
        return pd.Series(((sent.value[a >> 3] >> (a & 7)) & (sent.value[b >> 3] >> (b & 7)) & 1) == 1)

    return F.pandas_udf(found, "boolean")(*_places(F.col(phrase), bits))


def lexicon_join(
    comments: DataFrame, lexicon: DataFrame, key: str, text: str = "raw_text", default: str = DEFAULT_LABELS["feedback_category"]
) -> DataFrame:
    """``comments`` with ``feedback_category`` and ``matched_phrase``, from a ``lexicon`` of (phrase, category, priority).

    Of the phrases whose words come in a text one after another, the one of least ``priority`` decides, then of least phrase; a
    text with none gets ``default`` and a null phrase. A phrase is compared by its words; one without words is never found.
    ``key`` is unique among the comments. Only keys and word sequences move, and of those only as long as the lexicon's are. The
    lexicon's shortest phrases, as far as they are few, go to every task. Others are dealt by phrase, and Spark splits
    frequent ones; of the texts' word sequences only those that may be among them move, which a bitmap of bounded size tells.
    """
    known = lexicon.withColumn("_words", words(F.col("phrase"))).filter(F.size("_words") > 0)
    known = known.groupBy(F.array_join("_words", " ").alias("_phrase"), F.size("_words").alias("_n")).agg(
        F.min(F.struct("priority", "category")).alias("_best")
    )
    known = materialize(known, "lexicon")
    size = F.sum(F.octet_length("_phrase") + 24).alias("size")
    sizes = sorted((r["_n"], r["size"], r["n"]) for r in known.groupBy("_n").agg(size, F.count("*").alias("n")).collect())  # of the longest phrase's words, at most
    if not sizes:
        return comments.withColumns({"feedback_category": F.lit(default), "matched_phrase": F.lit(None).cast("string")})
    sums = np.cumsum([size for _, size, _ in sizes])
    few = [s for s, so_far in zip(sizes, sums) if so_far <= SMALL]
    matches = []
    for some in (few, sizes[len(few) :]):
        if not some:
            continue
        lengths = [n for n, _, _ in some]
        own = known.filter(F.col("_n").isin(lengths)).select("_phrase", "_best")
        own = materialize(own, "lexicon-part")  # so that Spark sees the size of each part
        each = comments.select(F.col(key).alias("_key"), F.explode(phrases(F.col(text), lengths)).alias("_phrase"))
        if some is not few:
            bits = min(MOST_BITS, (16 * sum(n for _, _, n in some)).bit_length())
            each = each.filter(may_be_among(own, "_phrase", bits))
        matches.append(each.join(own, "_phrase"))
    first = F.min(F.struct("_best.priority", "_phrase", "_best.category")).alias("_first")
    found = reduce(DataFrame.unionByName, matches).groupBy("_key").agg(first)
    joined = comments.join(found, F.col(key).eqNullSafe(F.col("_key")), "left")
    kept = [c for c in comments.columns if c not in ("feedback_category", "matched_phrase")]
    return joined.select(
        *kept, F.coalesce("_first.category", F.lit(default)).alias("feedback_category"), F.col("_first._phrase").alias("matched_phrase")
    )
