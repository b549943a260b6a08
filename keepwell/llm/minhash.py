"""MinHash near-duplicates: many universal hash minima, banding, signature and set verification, components.

1. Each text becomes a set of hashed word shingles; texts with equal sets are one class, and the class's first row stands
   for it. So copies, however many, cost one row each.
2. Minima of many universal hashes of a set, by bands, give buckets. In each bucket every class is compared with one of
   the bucket's; of those whose signatures agree, each class is verified with the likeliest, and joined with it. That is
   repeated in the buckets that still hold several components, with others of their classes, for as long as it joins some:
   a round lists no more pairs than there are classes in buckets, and a large group of near copies is soon one component.
3. Classes in buckets that still hold several components may have links that no comparison has met yet. They are joined
   by prefix filtering, which is exact: of two sets that are similar enough, the rarest shingles of each, as many as they
   may differ in and one more, have one in common. So the many pairs of a bucket are never listed.
4. A pair is verified by its signatures, with a margin no true pair misses in practice, and then by the whole sets.

Two sets of similarity ``s`` share no bucket with probability ``(1 - s ** rows) ** bands``: 2e-7 at 0.85 for 48 bands of 8
rows, 5e-7 at 0.8 for 48 of 6.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import resident, runs, small_batches, utf8
from keepwell.llm.components import components
from keepwell.session import materialize

U = np.uint64
#: Odd multipliers and shifts of the mixing steps: fixed values, any odd numbers would do.
MIX_1, MIX_2, STEP = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
SEED = 20_240_607
#: So many of the minima are kept, a byte of each, for the signature.
SIGNED = 192
#: So often at most are classes in open buckets compared with one of their bucket's, before all their pairs are looked for.
ROUNDS = 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * MIX_1
    x = (x ^ (x >> U(29))) * MIX_2
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, equal for A-Z and a-z; and which bytes are white space."""
    values = np.random.default_rng(SEED).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = 6364136223846793005
    inverse = pow(base, -1, 1 << 64)
    return tuple(
        np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (base, inverse)
    )


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z as a-z, and how many words each text has.

    Works through the bytes in parts of about ``most``, cut at white space; a longer word makes a longer part.
    """
    values, space = _tables()
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and not space[data[end - 1]]:
            ahead = np.flatnonzero(space[data[end : end + most]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + most, len(data))
        part = data[at:end]
        word = ~space[part]
        before = np.empty(len(part), bool)
        before[0], before[1:] = False, word[:-1]
        begin = np.flatnonzero(word & (~before | starts[at:end]))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, ~word[1:] | starts[at + 1 : end]
        stop = np.flatnonzero(word & after) + 1
        power, inverse = _powers(1 << max(20, int(len(part)).bit_length()))
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum(values[part] * power[: len(part)], out=sums[1:])
        own = (sums[stop] - sums[begin]) * inverse[begin]
        hashes.append(mixed(own + (stop - begin).astype(U) * STEP))
        firsts.append(begin + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    first = np.concatenate(firsts)
    counts = np.searchsorted(first, offsets[1:]) - np.searchsorted(first, offsets[:-1])
    return np.concatenate(hashes), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, end to end, and where each text's begin and the last one's end.

    A text of fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(data, offsets)
    sets, sizes, at = [], [0], 0
    for n in counts.tolist():
        own, at = words[at : at + n], at + n
        if n:
            runs_, length = max(n - width + 1, 1), min(n, width)
            made = np.full(runs_, length, U) * STEP
            for k in range(length):
                made = mixed(made + own[k : k + runs_])
            made = np.unique(made)
            sets.append(made)
            sizes.append(len(made))
        else:
            sizes.append(0)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.cumsum(np.array(sizes))


@lru_cache(maxsize=4)
def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of ``n`` universal hashes modulo 2**32."""
    rng = np.random.default_rng(SEED + 1)
    a, b = rng.integers(0, 2**32, (2, n), dtype=np.uint64).astype(np.uint32)
    return a | np.uint32(1), b


def minima(shingles: np.ndarray, offsets: np.ndarray, n: int, most: int = 1 << 15) -> np.ndarray:
    """``n`` universal hash minima per set, as 32-bit rows; a set without shingles has the largest value."""
    a, b = _universal(n)
    out = np.full((len(offsets) - 1, n), 0xFFFFFFFF, np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    for first, last in runs(offsets, most):
        at = offsets[first : last + 1]
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            part, begin = x[at[0] : at[-1]], (at[:-1] - at[0])[full]
            for k in range(n):
                out[first + full, k] = np.minimum.reduceat(part * a[k] + b[k], begin)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


SKETCH = "slot long, doc_id long, n_shingles long, key_1 long, key_2 long, buckets array<long>, signature binary"


def sketches(rows: DataFrame, width: int, bands: int, per_band: int) -> DataFrame:
    """Per row (slot, doc_id, text): its set's size, two hashes of the whole set, its buckets, and the low bytes of its first minima.

    Buckets of texts without words are empty.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("near", dict)  # nothing of another operator's is kept from here on
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for first, last in runs(offsets, 1 << 20):
                at = offsets[first : last + 1]
                sets, ends = shingle_sets(data[at[0] : at[-1]], at - at[0], width)
                sizes = np.diff(ends)
                lows = minima(sets, ends, bands * per_band)
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(mixed(sets * m))]) for m in (MIX_1, MIX_2)]
                keys = [signed(mixed(s[ends[1:]] - s[ends[:-1]] + sizes.astype(U))) for s in sums]
                bucket = np.tile(np.arange(1, bands + 1, dtype=U) * STEP, (last - first, 1))
                for k in range(per_band):
                    bucket = mixed(bucket + lows[:, k::per_band].astype(U))
                some = sizes > 0
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32), signed(bucket[some].ravel())
                )
                low_bytes = [row.tobytes() for row in lows[:, :SIGNED].astype(np.uint8)]
                part = batch.slice(first, last - first)
                columns = [*part.columns[:2], pa.array(sizes, pa.int64()), *map(pa.array, keys), lists, pa.array(low_bytes)]
                names = ["slot", "doc_id", "n_shingles", "key_1", "key_2", "buckets", "signature"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("slot", "doc_id", "text").mapInArrow(make, SKETCH)


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    """``slot`` and ``shingles``, the whole set, of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("near", dict)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in runs(offsets, 1 << 20):
                at = offsets[first : last + 1]
                sets, ends = shingle_sets(data[at[0] : at[-1]], at - at[0], width)
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), signed(sets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["slot", "shingles"])

    return rows.select("slot", "text").mapInArrow(make, "slot long, shingles array<long>")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, margin: float) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity and whose signatures, of which ``share`` are equal, are within the
    margin of it."""
    own = classes.select("rep", "n_shingles", "signature")
    one = own.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    two = own.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    joined = pairs.join(one, "a").join(two, "b")
    sized = joined.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    bound = percent / 100 - margin

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8) for i in (2, 3))
            share = (a == b).reshape(batch.num_rows, -1).mean(1) if batch.num_rows else np.zeros(0)
            columns = [*batch.columns[:2], pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "share"]).filter(pa.array(share >= bound))

    return sized.select("a", "b", "s_a", "s_b").mapInArrow(near, "a long, b long, share double")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which ``100 * intersection >= percent * union`` of the whole sets (slot, shingles)."""
    one = sets.select(F.col("slot").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("slot").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return joined.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def open_members(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(bucket, rep, component) of the buckets that hold several components. ``joined``: (node, component)."""
    placed = members.select("bucket", "rep").join(joined, F.col("rep") == F.col("node"), "left")
    placed = materialize(placed.select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "near-placed")
    mixed_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(mixed_.filter("low <> high").select("bucket"), "bucket")


def nearest_links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, margin: float) -> DataFrame:
    """The links between each ``b`` of the pairs (a, b) and the likeliest ``a`` that it has."""
    stars = likely(pairs, classes, percent, margin)
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a"))
    return materialize(verified(nearest, sets, percent), "near-links")


def crossing(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) between components, among classes that share a bucket with another component; every pair of such
    classes that is similar enough is there.

    Shingles are ordered by how many of these sets have them. Those that only one has come first and pair nothing,
    so near copies that differ in too much, and texts with a passage in common, give few pairs or none.
    """
    open_ = materialize(placed.select("rep", "component").distinct(), "near-open")
    own = sets.withColumnRenamed("slot", "rep").join(open_, "rep")
    own = materialize(own.select("rep", "component", F.size("shingles").alias("n"), "shingles"), "near-open-sets")
    each = own.select("rep", "component", "n", F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("sets")).filter("sets > 1")
    rare = each.join(shared, "shingle").groupBy("rep", "component", "n").agg(
        F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared")
    )
    least = F.floor((F.col("n") * percent + 99) / 100)  # of a set's shingles, those that a similar one must have
    own_only = F.col("n") - F.size("shared")
    prefix = F.slice("shared", F.lit(1), F.greatest(F.col("n") - least + 1 - own_only, F.lit(0)).cast("int"))
    rows = rare.select("rep", "n", "component", own_only.alias("own_only"), F.posexplode(prefix).alias("at", "of"))
    after = (F.col("n") - F.col("own_only") - F.col("at") - 1).alias("after")  # shingles behind this one
    rows = materialize(rows.select("rep", "n", "component", after, F.col("of.shingle").alias("shingle")), "near-prefixes")

    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # at the first shingle that two sets have in common, only what is behind it in both can be common too
    enough = (100 + percent) * (1 + F.least("after_a", "after_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = meeting(rows, sized & enough)
    return pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def meeting(rows: DataFrame, condition: Column) -> DataFrame:
    """The pairs of rows (rep, n, component, after, shingle) with one shingle and different components that satisfy the
    condition, each once.

    The components of a shingle are numbered, and two of them meet at the highest binary digit in which their numbers differ:
    rows with the same digits above it, a 0 there and a 1. So rows of one component are never compared, however many share a
    shingle; a row is looked up as often as the largest number has digits.
    """
    several = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = materialize(rows.join(several.filter("low <> high").select("shingle"), "shingle"), "near-meeting")
    own = Window.partitionBy("shingle")
    numbered = open_.select("shingle", "component").distinct().withColumn("place", F.row_number().over(own.orderBy("component")) - 1)
    digits = F.length(F.bin(F.max("place").over(own.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    placed = open_.join(numbered.withColumn("digits", digits), ["shingle", "component"])
    placed = placed.withColumn("digit", F.explode(F.sequence(F.lit(0), F.col("digits") - 1)))
    placed = placed.withColumn("above", F.expr("shiftright(place, digit + 1)")).withColumn("bit", F.expr("shiftright(place, digit) & 1"))

    def side(name: str, bit: int) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "component", "after")]
        return placed.filter(F.col("bit") == bit).select("shingle", "digit", "above", *columns)

    return side("a", 0).join(side("b", 1), ["shingle", "digit", "above"]).filter(condition).drop("digit", "above")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 48,
    per_band: int = 6,
    margin: float = 0.17,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``first`` for each document, and the columns ``keep``.

    Texts are linked by ``100 * intersection >= percent * union`` of their sets of distinct shingles of ``width`` words
    (runs without ASCII white space, A-Z as a-z). ``component_id`` is the smallest ``doc_id`` reachable by links.
    ``kept``: the document has that id. ``first``: it is the one row of its component that stays, the first with that id;
    so it also chooses among rows with equal ids. A text of fewer words is one shingle; null texts and texts without
    words have none and are linked with nothing, each a component of its own. Documents without an id are linked like
    others but name no component; a component of such only has a null ``component_id``, and its rows are ``kept``.
    Texts of any length are compared whole; repeated rows are copies of each other; an empty table gives no rows; columns
    that aren't kept aren't read, and those kept may not be named like the ones returned.
    """
    own = (F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = small_batches(docs).select(*own, *keep)
    texts = materialize(texts.withColumn("slot", F.monotonically_increasing_id()), "near-texts")
    made = materialize(sketches(texts, width, bands, per_band), "near-sketches")
    has = made.filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "slot")
    classes = has.groupBy("key_1", "key_2").agg(F.min("slot").alias("rep"), F.min(order).alias("first"))
    classes = materialize(classes, "near-classes")
    reps = materialize(
        has.join(classes.select("rep"), F.col("slot") == F.col("rep")).select("rep", "n_shingles", "signature", "buckets"),
        "near-reps",
    )
    members = reps.select("rep", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1")
    members = materialize(members.join(shared.drop("n"), "bucket"), "near-members")

    # what may be linked at all; their texts are the only ones that move
    ends = members.select(F.col("rep").alias("slot")).distinct()
    sets = materialize(whole_sets(texts.join(ends, "slot", "left_semi"), width), "near-sets")

    links = nearest_links(members.filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), reps, sets, percent, margin)
    joined = materialize(components(links), "near-joined")
    placed = open_members(members, joined)
    for turn in range(ROUNDS):
        chosen = F.min_by(F.struct("rep", "component"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep")).alias("chosen")
        pairs = placed.join(placed.groupBy("bucket").agg(chosen), "bucket").filter("component <> chosen.component")
        found = nearest_links(pairs.select(F.col("chosen.rep").alias("a"), F.col("rep").alias("b")).distinct(), reps, sets, percent, margin)
        if found.isEmpty():
            break
        links = materialize(links.union(found.select(links.columns)), "near-links")
        joined = materialize(components(links), "near-joined")
        placed = open_members(placed, joined)
    rest = materialize(likely(crossing(placed, sets, percent), reps, percent, margin), "near-rest")
    more = materialize(verified(rest, sets, percent), "near-more") if rest.take(1) else rest
    all_ = components(links.union(more.select("a", "b"))) if more.take(1) else joined

    named = classes.join(all_, F.col("rep") == F.col("node"), "left")
    named = named.select("key_1", "key_2", "first", F.coalesce("component", "rep").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("best"))
    named = materialize(named.drop("first").join(firsts, "component").select("key_1", "key_2", "best"), "near-named")
    out = has.drop("buckets", "signature").join(named, ["key_1", "key_2"])
    alone = made.filter("n_shingles = 0").select("slot", "doc_id", "n_shingles", order.alias("best"))
    out = out.select("slot", "doc_id", "n_shingles", "best").union(alone)
    answer = out.select(
        "slot",
        "doc_id",
        "n_shingles",
        F.col("best.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"),
        (F.col("slot") == F.col("best.slot")).alias("first"),
    )
    if not keep:
        return answer.drop("slot")
    return answer.join(texts.select("slot", "text", *keep), "slot").drop("slot")
