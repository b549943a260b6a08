"""Mixing sources to target weights by apportioned blocks of words.

A target per source comes from weights, capped by how often a text may repeat. The Sainte-Lague rule (highest
quotient ``target / (2 * blocks + 1)`` gets the next block) turns targets into whole blocks per source, and again
a source's blocks into whole blocks per shard of that source. Within a shard the texts lie end to end in seeded
order, and the shard's quota is taken from its start, going round again if it is longer than the shard.

Only tables with one row per source, or per source and shard, are ever ordered as a whole; a source with a third
of all rows is spread over all shards.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepwell.llm.common import WORD, numbered, small_batches, whole_text, word_count
from keepwell.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
WORDS = re.compile(WORD)


def capped_shares(size: np.ndarray, weight: np.ndarray, share: float, most: float) -> np.ndarray:
    """Shares of ``share * sum(size)`` by weight, none above ``most * size``; what is cut off is shared again."""
    total, cap = share * size.sum(), most * size
    target, open_ = np.zeros(len(size)), size > 0
    left = min(total, cap.sum())
    while open_.any():
        fair = left * weight / weight[open_].sum()
        over = open_ & (fair > cap)
        if not over.any():
            target[open_] = fair[open_]
            break
        target[over] = cap[over]
        left -= cap[over].sum()
        open_ &= ~over
    return target


def sainte_lague(target: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Whole seats by highest quotients ``target / (2 * seats + 1)``, at most ``most`` each; ties go to the earlier.

    Rounding at one common divisor gives all but a few seats; the rest are dealt one by one from a heap, so the
    work doesn't grow with the number of seats.
    """
    seats = int(min(seats, most[target > 0].sum()))
    got = np.zeros(len(target), np.int64)
    if seats <= 0:
        return got

    def at(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(target / divisor + 0.5).astype(np.int64), np.where(target > 0, most, 0))

    low, high = target.sum() / (4.0 * (seats + len(target))), 4.0 * target.sum()
    while at(low).sum() < seats:
        low /= 2
    for _ in range(100):  # at(high) has too few seats or just enough, at(low) enough
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() >= seats else (low, middle)
    got = at(high)
    heap = [(-t / (2 * g + 1), i) for i, (t, g, m) in enumerate(zip(target, got, most)) if t > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-target[i] / (2 * got[i] + 1), i))
    return got


def _rows(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), whole_text())
    size = word_count(whole_text())
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"),
                       place.alias("place"), *more)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = 16,
    seed: int = 17,
    least_shards: int = 64,
    rows_per_shard: int = 1_000_000,
) -> DataFrame:
    """How many words of each document a mix takes: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` (of
    the source), ``taken``, ``slot`` (a number per row).

    Sources in code point order, null last, take the weights in turn. ``share`` of all words is dealt out; no source
    (and no document) gives more than ``most`` times its words. A source's blocks sum to its target but for half a
    block or so; a source at its limit gives all it may. Order and quotas depend on ``doc_id``, text and ``seed`` only, so reruns agree; which of several
    equal rows (same id, same text) gives more words is open. A null text or one without words has size 0 and
    gives nothing; a source without words has target 0. No documents give no rows. Other columns are left out.
    """
    return _mix(numbered(_rows(docs, seed), "mix-rows"), weights, share, most, block, least_shards, rows_per_shard).drop("place")


def _mix(
    rows: DataFrame, weights: Sequence[float], share: float, most: float, block: int, least_shards: int, per_shard: int
) -> DataFrame:
    counted = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shards = F.greatest(F.lit(least_shards), F.ceil(F.col("n") / F.lit(per_shard))).cast("int")

    def quotas(sources: pd.DataFrame) -> pd.DataFrame:
        names = [(s is None, s or "") for s in sources["source"]]
        sources = sources.iloc[sorted(range(len(names)), key=names.__getitem__)].reset_index(drop=True)
        size = sources["source_size"].to_numpy(np.float64)
        weight = np.array([weights[i % len(weights)] for i in range(len(size))], np.float64)
        target = capped_shares(size, weight, share, most)
        limit = np.ceil(size * most / block).astype(np.int64)
        blocks = sainte_lague(target, round(target.sum() / block), limit)
        full = target >= most * size  # all that its shards have
        return sources.assign(target=target, blocks=np.where(full, 2**60, blocks))

    by_source = materialize(
        counted.withColumn("shards", shards)
        .groupBy()
        .applyInPandas(quotas, "source string, source_size long, n long, shards int, target double, blocks long"),
        "mix-sources",
    ).withColumnRenamed("source", "of")
    dealt = materialize(
        rows.join(by_source, rows["source"].eqNullSafe(by_source["of"]))
        .withColumn("shard", F.pmod(F.col("place"), F.col("shards")).cast("int"))
        .drop("of", "n", "shards"),
        "mix-shards",
    )

    def shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("of_shard").reset_index(drop=True)
        size = shards["shard_size"].to_numpy(np.float64)
        limit = np.ceil(size * most / block).astype(np.int64)
        quota = sainte_lague(size, int(shards["blocks"].iloc[0]), limit) * block
        return shards.assign(quota=quota)[["of", "of_shard", "shard_size", "quota"]]

    by_shard = (
        dealt.groupBy(F.col("source").alias("of"), F.col("shard").alias("of_shard"))
        .agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
        .groupBy("of")
        .applyInPandas(shard_quotas, "of string, of_shard int, shard_size long, quota long")
    )
    laid = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "slot")
    placed = dealt.withColumn("start", F.sum("size").over(laid) - F.col("size")).join(
        by_shard, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard"))
    )
    quota = F.least(F.col("quota"), F.floor(F.col("shard_size") * F.lit(most)))
    passes = F.when(F.col("shard_size") > 0, F.floor(quota / F.col("shard_size"))).otherwise(0).cast("bigint")
    rest = quota - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = (passes * F.col("size") + part).cast("bigint").alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, "slot", "place")


def first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word; a null count gives null."""

    def cut(text: str | None, n: float) -> str | None:
        if text is None or n != n:
            return None
        last = next(islice(WORDS.finditer(text), int(n) - 1, None), None)
        return text if last is None else text[: last.end()]

    return pd.Series([cut(text, n) for text, n in zip(texts, counts)], dtype=object)


def whole_documents(taken: DataFrame, most: float) -> DataFrame:
    """``taken`` with passes over whole texts only. Of each shard's text within which its last pass ends (one row at most), the
    source takes all or nothing, whichever is nearer to its quota so far; what that is over or under goes to its next shard.
    So a source's words differ from its quota by half a text at most, or where ``most`` allows no further pass."""

    def settle(cuts: pd.DataFrame) -> pd.DataFrame:
        cuts = cuts.sort_values(["place", "doc_id", "slot"])
        over, settled = 0, []
        for size, words in zip(cuts["size"].tolist(), cuts["taken"].tolist()):
            part = words % size
            more = words // size + 1 <= most and abs(over + size - part) <= abs(over - part)
            over += size - part if more else -part
            settled.append(words - part + size * more)
        return pd.DataFrame({"cut": cuts["slot"], "settled": np.array(settled, np.int64)})

    taken = materialize(taken.filter("taken > 0"), "mix-taken")
    cuts = taken.filter("taken % size > 0").groupBy("source").applyInPandas(settle, "cut long, settled long")
    both = taken.join(cuts, F.col("slot") == F.col("cut"), "left")
    return both.withColumn("taken", F.coalesce("settled", "taken"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = 16,
    seed: int = 17,
    least_shards: int = 64,
    rows_per_shard: int = 1_000_000,
    whole: bool = False,
) -> DataFrame:
    """The mix itself, with the columns of documents: a row per whole pass over a text, and one with its first words
    where the last pass ends within it. ``n_chars`` is that of the row's text. A text from which the mix takes
    nothing has no row. ``whole``: no text is cut (see ``whole_documents``). The rest is as for ``mix_sources``."""
    stored = numbered(_rows(small_batches(docs), seed, "text", "lang"), "mix-texts")
    narrow = stored.select("doc_id", "source", "size", "place", "slot")
    taken = _mix(narrow, weights, share, most, block, least_shards, rows_per_shard)
    taken = (whole_documents(taken, most) if whole else taken).filter("taken > 0").select("slot", "taken")
    passes = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.col("taken") % F.col("size")
    counts = F.concat(
        F.array_repeat(F.lit(None).cast("bigint"), passes), F.when(rest > 0, F.array(rest)).otherwise(F.array())
    )
    rows = stored.join(taken, "slot").withColumn("words", F.explode(counts))
    cut = F.pandas_udf(first_words, "string")(F.when(F.col("words").isNotNull(), F.col("text")), F.col("words"))
    return rows.withColumn("text", F.when(F.col("words").isNull(), F.col("text")).otherwise(cut)).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")
    )
