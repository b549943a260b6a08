"""Phrase collocations by stripes.

A stripe is a counter of next words under a prefix of one or two words. Tasks count stripes of the texts they read, which are
merged elementwise: entries are counts of extensions, their sum, with the times that a piece of text ends after the prefix, is
the count of the prefix, and their maximum says whether an extension takes the phrase's place. A stripe is dealt out by a
hash of the next word, so that one of a very frequent prefix is merged by many tasks.

Two-word prefixes are counted after one-word ones: a phrase that comes often enough consists of phrases that do. A
bitmap of bounded size, by hashes of those, tells tasks which to count; a wrong bit costs a count, not a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwell.llm.common import runs, small_batches, utf8, whole_text
from keepwell.session import materialize

#: What ends a piece of text becomes a byte that UTF-8 never has, a tab a space; A to Z become small.
END = b"\xff"
SIGNS = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)
#: Words that a task counts before it hands their stripes on.
AT_ONCE = 3_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)

STRIPES = "lang string, prefix string, part int, ends long, next array<string>, n array<long>"
MERGED = "lang string, prefix string, total long, next array<string>, n array<long>"


class Numbers(dict):
    """Words numbered as they come; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


class Chunk:
    """Words of one language, by number, a task's share at a time."""

    def __init__(self):
        self.numbers, self.parts, self.size = Numbers({END: 0}), [], 0

    def add(self, text: bytes) -> None:
        """Texts, each with END after it. A text's line ends and marks end pieces as well."""
        words = text.translate(SIGNS).replace(END, b" \xff ").split(b" ")
        own = np.fromiter(map(self.numbers.__getitem__, filter(None, words)), np.int64)
        self.parts.append(own)
        self.size += len(own)

    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """All words' numbers in order, with an end before and after, and the words."""
        return np.concatenate([np.zeros(1, np.int64), *self.parts, np.zeros(1, np.int64)]), list(self.numbers)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64 bits that spread well, from a word's CRC-32 and Adler-32."""
    low, high = (np.fromiter(map(f, words), np.uint64, len(words)) for f in (zlib.crc32, zlib.adler32))
    mixed = (low | high << np.uint64(32)) * ODD
    return mixed ^ (mixed >> np.uint64(29))


def pair_places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a pair of words in a bitmap of 2 ** ``bits``, by the words' hashes."""
    mixed = (first * ODD + second) * ODD
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _stripes(lang: str, prefixes: np.ndarray, nexts: np.ndarray, counts: np.ndarray, names, words: list[bytes], split: int):
    """Arrow rows of stripes from ``counts[i]`` times the word ``nexts[i]`` (0: end) after the prefix ``prefixes[i]``.
    ``names`` makes the prefixes' texts."""
    spread = word_hashes(words) >> np.uint64(40)
    part = np.where(nexts == 0, 0, (spread % np.uint64(split)).astype(np.int64)[nexts])
    order = np.lexsort((part, prefixes))
    prefixes, nexts, counts, part = prefixes[order], nexts[order], counts[order], part[order]
    begin = np.flatnonzero(np.diff(prefixes * split + part, prepend=-1))
    ends = np.add.reduceat(np.where(nexts == 0, counts, 0), begin)
    inner = nexts != 0
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(inner.astype(np.int64), begin))]).astype(np.int32)
    known = pa.array(words, pa.binary()).cast(pa.string(), safe=False)
    columns = [
        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(begin), np.int64))),
        names(prefixes[begin]),
        pa.array(part[begin], pa.int32()),
        pa.array(ends, pa.int64()),
        pa.ListArray.from_arrays(offsets, known.take(pa.array(nexts[inner]))),
        pa.ListArray.from_arrays(offsets, pa.array(counts[inner], pa.int64())),
    ]
    whole = pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "part", "ends", "next", "n"])
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def _word_stripes(lang: str, chunk: Chunk, split: int) -> Iterator[pa.RecordBatch]:
    """Stripes of one-word prefixes."""
    at, words = chunk.words()
    first, second = at[:-1], at[1:]
    codes, counts = np.unique((first << 32 | second)[first != 0], return_counts=True)
    if len(codes):
        known = pa.array([w if i else b"" for i, w in enumerate(words)], pa.binary()).cast(pa.string())
        prefix, following = codes >> 32, codes & 0xFFFFFFFF
        words = [w if i else b"" for i, w in enumerate(words)]
        yield from _stripes(lang, prefix, following, counts, lambda p: known.take(pa.array(p)), words, split)


def _pair_stripes(lang: str, chunk: Chunk, split: int, bits: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of two-word prefixes, of phrases whose pairs ``often`` may all have."""
    at, words = chunk.words()
    first, second = at[:-1], at[1:]
    codes, pair = np.unique(first << 32 | second, return_inverse=True)
    hashes = word_hashes(words)
    a, b = codes >> 32, codes & 0xFFFFFFFF
    place = pair_places(hashes[a], hashes[b], bits)
    live = (a != 0) & (b != 0) & ((often[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
    both = live[pair[:-1]] & live[pair[1:]]
    triples, counts = np.unique((pair[:-1].astype(np.int64) << 32 | second[1:])[both], return_counts=True)
    if len(triples):
        words = [w if i else b"" for i, w in enumerate(words)]
        known = pa.array(words, pa.binary()).cast(pa.string())

        def names(p: np.ndarray) -> pa.Array:
            return pc.binary_join_element_wise(known.take(pa.array(a[p])), known.take(pa.array(b[p])), " ")

        yield from _stripes(lang, triples >> 32, triples & 0xFFFFFFFF, counts, names, words, split)


def _counted(docs: DataFrame, make, at_once: int) -> DataFrame:
    """The stripes that ``make`` yields of the chunks of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, Chunk] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                data, offsets = utf8(batch.column(1).filter(pa.array(langs == lang)))
                for i, j in runs(offsets, 1 << 21):
                    chunk = chunks.setdefault(lang, Chunk())
                    texts = zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist())
                    chunk.add(END.join([data[a:b].tobytes() for a, b in texts] + [b""]))
                    if sum(c.size for c in chunks.values()) >= at_once:
                        for name, full in chunks.items():
                            yield from make(name, full)
                        chunks.clear()
        for lang, chunk in chunks.items():
            yield from make(lang, chunk)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    return small_batches(rows).mapInArrow(run, STRIPES)


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """The stripes' parts, each merged elementwise: ``total`` (of all entries and ends) and the entries of at least
    ``least``. A part is merged from rows in order, so a task holds one part and one batch at a time."""

    def merged(row: np.ndarray, total: np.ndarray, nexts: pa.Array, n: np.ndarray) -> tuple:
        codes = nexts.dictionary_encode()
        pairs, inverse = np.unique(row << 32 | codes.indices.to_numpy().astype(np.int64), return_inverse=True)
        summed = np.zeros(len(pairs), np.int64)
        np.add.at(summed, inverse, n)
        np.add.at(total, pairs >> 32, summed)
        kept = summed >= least
        return total, codes.dictionary.take(pa.array((pairs & 0xFFFFFFFF)[kept])), summed[kept], (pairs >> 32)[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "prefix", "part", "ends", "next", "n"]
        rest = None
        for batch in _with_last(batches):
            if batch is not None and not batch.num_rows:
                continue
            here = [b for b in (rest, batch) if b is not None]
            if not here:
                continue
            whole, rest = pa.concat_batches(here) if len(here) > 1 else here[0], None
            key = [whole.column(i) for i in range(3)]
            change = np.zeros(whole.num_rows, bool)
            change[0] = True
            for column in key:
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(change)
            cut = int(begin[-1]) if batch is not None else whole.num_rows
            if batch is not None:
                rest = _compact(whole.slice(cut), names)
            if not cut:
                continue
            own, group = whole.slice(0, cut), np.cumsum(change)[:cut] - 1
            lists = own.column(4)
            row = np.repeat(group, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.zeros(group[-1] + 1, np.int64)
            np.add.at(ends, group, own.column(3).to_numpy())
            total, nexts, n, at = merged(row, ends, lists.flatten(), own.column(5).flatten().to_numpy())
            offsets = np.searchsorted(at, np.arange(len(total) + 1)).astype(np.int32)
            first = pa.array(begin[: len(total)])
            columns = [
                own.column(0).take(first), own.column(1).take(first), pa.array(total, pa.int64()),
                pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "total", "next", "n"])

    dealt = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    return dealt.mapInArrow(run, MERGED)


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and a None that says that there are no more."""
    yield from batches
    yield None


def _compact(rows: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """One row that has the entries of these rows of one key, each word once."""
    codes = rows.column(4).flatten().dictionary_encode()
    n = np.bincount(codes.indices.to_numpy(), rows.column(5).flatten().to_numpy(), len(codes.dictionary)).astype(np.int64)
    ends = np.array([0, len(n)], np.int32)
    columns = [
        *(rows.column(i).slice(0, 1) for i in range(3)), pa.array([int(np.sum(rows.column(3).to_numpy()))], pa.int64()),
        pa.ListArray.from_arrays(ends, codes.dictionary), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def _bitmap(spark: SparkSession, pairs: DataFrame, most_bits: int) -> tuple[int, np.ndarray]:
    """The bits of all pairs (``first``, ``second``): sixteen or more for each, but no more than 2 ** ``most_bits``."""
    bits = min(most_bits, max(15, (16 * pairs.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (word_hashes([w.encode() for w in batch.column(i).to_pylist()]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_places(a, b, bits), pa.int64())], ["at"])

    at = pairs.select("first", "second").mapInArrow(place, "at long").withColumn("at", F.col("at") + 1)
    built = at.groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bitmap"))
    found = np.zeros((1 << bits) // 8, np.uint8)
    for row in built.toLocalIterator():
        own = np.frombuffer(bytes(row["bitmap"]), np.uint8)
        found[(row["bucket"] - 1) * len(own) :][: len(own)] = own
    return bits, found


def _wide(column: str) -> Column:
    """Counts as decimals, so that products are exact: two of them and a million have at most 37 digits."""
    return F.col(column).cast("decimal(14,0)")


def _score(left: str, right: str) -> Column:
    over = F.lit(1_000_000).cast("decimal(7,0)") * (_wide("a") * _wide("a"))
    return F.call_function("div", over, _wide(left) * _wide(right)).cast("bigint")


def collocations(docs: DataFrame, least: int = 10, percent: int = 50, most: int = 2000, split: int | None = None, most_bits: int = 27, at_once: int = AT_ONCE) -> DataFrame:
    """Each language's best phrases of two or three words: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r``
    (those of its parts), ``n`` (all words) and ``score``.

    Texts are lower-cased (A to Z) and split into pieces at marks and line ends; phrases don't pass them. A phrase that comes
    ``least`` times is a candidate; its score is floor(1000000 a a / (l r)) at the cut where it is least, of equal ones the
    first. Candidates inside a longer candidate that comes at least ``percent`` per cent as often go. The first ``most``
    by score, count and phrase are returned. ``split``: into how many parts stripes are dealt (by default, as many as a
    quarter of the input partitions, 8 at least). ``at_once``: how many words a task counts before it hands stripes on.

    A null ``lang`` is ``und``; null and empty texts have no words; repeated rows count each; texts of any length are
    counted whole; no documents give no rows. Only ``text`` and ``lang`` are read.
    """
    spark = docs.sparkSession
    split = split or max(8, small_batches(docs).rdd.getNumPartitions() // 4)
    counted = _counted(docs, lambda lang, chunk: _word_stripes(lang, chunk, split), at_once)
    words = materialize(merge_stripes(counted, least), "word-stripes")
    sizes = words.groupBy("lang").agg(F.sum("total").alias("n"))
    totals = words.groupBy("lang", "prefix").agg(F.sum("total").alias("total")).filter(F.col("total") >= least)
    totals = materialize(totals, "word-totals")
    entries = F.explode(F.arrays_zip("next", F.col("n").alias("times"))).alias("entry")
    pairs = words.select("lang", F.col("prefix").alias("first"), entries).select("lang", "first", F.col("entry.next").alias("second"), F.col("entry.times").alias("a"))
    pairs = materialize(pairs, "pairs")
    bits, often = _bitmap(spark, pairs.select("first", "second").distinct(), most_bits)
    sent = spark.sparkContext.broadcast(often)
    counted = _counted(docs, lambda lang, chunk: _pair_stripes(lang, chunk, split, bits, sent.value), at_once)
    stripes = merge_stripes(counted, least)
    triples = stripes.select("lang", F.split("prefix", " ").alias("pair"), entries).select(
        "lang", F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"),
        F.col("entry.next").alias("third"), F.col("entry.times").alias("a"),
    )
    triples = materialize(triples, "triples")

    def word(name: str, count: str) -> DataFrame:
        return totals.select("lang", F.col("prefix").alias(name), F.col("total").alias(count))

    def pair(first: str, second: str, count: str) -> DataFrame:
        return pairs.select("lang", F.col("first").alias(first), F.col("second").alias(second), F.col("a").alias(count))

    twos = pairs.join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
    taken = triples.select("lang", "first", "second", "a").unionByName(
        triples.select("lang", F.col("second").alias("first"), F.col("third").alias("second"), "a")
    )
    longest = taken.groupBy("lang", "first", "second").agg(F.max("a").alias("longest"))
    twos = twos.join(longest, ["lang", "first", "second"], "left")
    twos = twos.filter(F.coalesce(100 * F.col("longest") < percent * F.col("a"), F.lit(True)))
    twos = twos.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), "a", "l", "r", _score("l", "r").alias("score"))
    threes = (
        triples.join(word("first", "l1"), ["lang", "first"])
        .join(word("third", "r2"), ["lang", "third"])
        .join(pair("first", "second", "l2"), ["lang", "first", "second"])
        .join(pair("second", "third", "r1"), ["lang", "second", "third"])
        .withColumn("s1", _score("l1", "r1"))
        .withColumn("s2", _score("l2", "r2"))
    )
    early = F.col("s1") <= F.col("s2")
    threes = threes.select(
        "lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = twos.unionByName(threes).withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= most).join(sizes, "lang")  # cut to the first rows before the shuffle, too
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
