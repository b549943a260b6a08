"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased runs of letters, the beginnings of longer ones, and beginnings that come two or three times, so that
forms of a word that no example has share a term with those that one has. The vocabulary is every term, of either class or
neutral, that two families of examples have; a term weighs its inverse document frequency, and more the better it tells the
classes apart by a chi-squared test. Spark counts and numbers the terms and makes the examples' entries; workers
build the index of them: postings of the rarer terms, and columns of the frequent ones in blocks of examples, for which a block
has the largest weight in it. A batch of queries adds up the rarer terms' postings and the blocks' bounds, and scores
blocks by a product each unless their bound can't reach the k nearest any more; those that can be among the nearest are scored
again in full, so the k nearest are exact. Neighbours vote by similarity; votes are calibrated on the examples, each scored
without itself.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import numbered, resident, small_batches, whole_text
from keepwell.llm.scoring import with_scores
from keepwell.operators.ranking import position_in_group
from keepwell.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (4, 6)
OFTEN = (2, 3)
#: More than the error of a similarity that was added up in single precision.
SLACK = 1e-4
#: Queries that are looked up at a time, and their postings; one query may have more, at most all there are.
AT_ONCE, POSTINGS = 64, 1_000_000


def count_terms(text: str) -> Counter:
    """How often a text has each word; each beginning of a longer word, marked by a tilde; and, as terms of their own,
    the beginnings of at least two and of at least three longer words."""
    words = Counter(LETTERS.findall(text.lower()))
    stems = Counter()
    for word, n in words.items():
        for size in STEMS:
            if len(word) > size:
                stems[f"{word[:size]}~"] += n
    often = Counter({f"{stem}{least}": 1 for stem, n in stems.items() for least in OFTEN if n >= least})
    return words + stems + often


def family(text: str) -> int:
    """One MinHash value over runs of three words: near copies mostly share it."""
    words = text.lower().split()
    runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [words]
    return min(zlib.crc32(" ".join(run).encode()) for run in runs)


def examples(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` and ``weight`` of at most ``most`` labelled documents of each class, the same for
    each run: those with the smallest hashes. ``weight``: how many labelled documents of its class each stands for."""
    known = labels.filter(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    chosen = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        .withColumn("weight", F.lit(max(1.0, sizes.get(c, 0) / most))) for c in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")


def with_terms(found: DataFrame) -> DataFrame:
    """``slot``, ``doc_id``, ``label``, ``weight``, ``family`` and ``terms``, a map from term to count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("toxicity", dict)  # nothing of another operator's is kept from here on
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(4).to_pylist()
                columns = [
                    *part.columns[:4], pa.array([family(x) for x in texts], pa.int64()),
                    pa.array([list(count_terms(x).items()) for x in texts], pa.map_(pa.string(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "label", "weight", "family", "terms"])

    rows = found.select("slot", "doc_id", "label", "weight", "text")
    return rows.mapInArrow(count, "slot long, doc_id long, label int, weight double, family long, terms map<string,long>")


def vocabulary(counted: DataFrame, least: float) -> DataFrame:
    """``term``, ``weight`` and ``number`` (its place in order, from 0) of all terms that two families of near copies have.
    The weight is the inverse document frequency times 1 + chi-squared (with Yates' correction) / ``least``; families count once."""
    of = {c: F.when(F.col("label") == c, F.col("family")) for c in (0, 1)}
    n0, n1 = map(float, counted.agg(*[F.count_distinct(of[c]) for c in (0, 1)]).first())
    found = (
        counted.select("label", "family", F.explode(F.map_keys("terms")).alias("term"))
        .groupBy("term")
        .agg(*[F.size(F.collect_set(of[c])).cast("double").alias(name) for c, name in ((1, "one"), (0, "zero"))])
        .filter((F.col("one") + F.col("zero") >= 2) & F.lit(n0 > 0 and n1 > 0))
    )
    n, one, zero = F.lit(n0 + n1), F.col("one"), F.col("zero")
    both = one + zero
    apart = F.greatest(F.abs(one * (n0 - zero) - zero * (n1 - one)) - n / 2, F.lit(0.0))
    chi = n * apart * apart / F.greatest(both * (n - both) * (n1 * n0), F.lit(1.0))
    weighed = found.select("term", ((F.log(n / both) + 1) * (1 + chi / least)).alias("weight"), F.lit(0).alias("all"))
    return materialize(position_in_group(weighed, ["all"], ["term"], "number").drop("all"), "toxicity-terms")


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begin[i]`` to ``begin[i] + sizes[i]``, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Rows:
    """Vectors of length 1, end to end: row ``i`` has the terms and values from ``begin[i]`` to ``begin[i + 1]``."""

    begin: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.begin) - 1

    def part(self, first: int, last: int) -> Rows:
        a, b = self.begin[first], self.begin[last]
        return Rows(self.begin[first : last + 1] - a, self.term[a:b], self.value[a:b])


def weighed(begin: np.ndarray, term: np.ndarray, n: np.ndarray, weight: np.ndarray) -> Rows:
    """Vectors of terms (in order) that come ``n`` times each."""
    value = (1 + np.log(n)) * weight[term]
    sizes = np.diff(begin)
    length = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), value * value, len(sizes)))
    return Rows(begin, term, value / np.repeat(np.maximum(length, 1e-300), sizes))


class Terms:
    """Numbers and counts of the terms of texts, a batch at a time, as ``count_terms`` has them."""

    def __init__(self, names: pa.StringArray):
        marked = np.array(pc.match_substring_regex(names, r"~[0-9]$").to_pylist(), bool)
        stems = pc.utf8_slice_codeunits(names.filter(pa.array(marked)), 0, -1)
        extra = stems.filter(pc.invert(pc.is_in(stems, names))).unique()  # beginnings that are only counted for how often they come
        self.size, self.names = len(names), pa.concat_arrays([names, extra])
        self.often = np.full((len(OFTEN), len(self.names)), -1, np.int64)
        for name, number in zip(names.filter(pa.array(marked)).to_pylist(), np.flatnonzero(marked).tolist()):
            row = OFTEN.index(int(name[-1]))
            self.often[row, number] = -2  # filled below, by its beginning
        for row, least in enumerate(OFTEN):
            own = np.flatnonzero(self.often[row] == -2)
            self.often[row, own] = -1
            begins = pc.utf8_slice_codeunits(self.names.take(pa.array(own)), 0, -1)
            self.often[row, pc.index_in(begins, self.names).to_numpy(zero_copy_only=False).astype(np.int64)] = own

    def counted(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``begin``, ``term`` and ``n`` of all texts, terms in order."""
        words = [LETTERS.findall(text.lower()) for text in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        unique, width = codes.dictionary, max(1, len(codes.dictionary))
        key, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + codes.indices.to_numpy(), return_counts=True)
        text, word = np.divmod(key, width)
        long = pc.utf8_length(unique).to_numpy()
        numbers = [pc.index_in(unique, self.names)]
        for size in STEMS:
            stem = pc.binary_join_element_wise(pc.utf8_slice_codeunits(unique, 0, size), "~", "")
            numbers.append(pc.if_else(pa.array(long > size), pc.index_in(stem, self.names), pa.scalar(None, pa.int32())))
        found = [x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[word] for x in numbers]
        total, here = len(self.names) + 1, [x >= 0 for x in found]
        keys = np.concatenate([text[h] * total + x[h] for x, h in zip(found, here)])
        keys, inverse = np.unique(keys, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([times[h] for h in here]), len(keys)).astype(np.int64)
        text, term = np.divmod(keys, total)
        rows, terms, counts = [text[term < self.size]], [term[term < self.size]], [n[term < self.size]]
        for row, least in enumerate(OFTEN):
            mark = np.where(n >= least, self.often[row, term], -1)
            rows.append(text[mark >= 0]), terms.append(mark[mark >= 0]), counts.append(np.ones((mark >= 0).sum(), np.int64))
        row, term, n = (np.concatenate(x) for x in (rows, terms, counts))
        order = np.lexsort((term, row))
        return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), term[order], n[order]


class Index:
    """The examples' vectors: whole, as postings of the rarer terms, and as columns, in blocks of ``size``, of the terms that
    more than a tenth of the examples have, with the largest weight of each in each block."""

    def __init__(self, names: pa.StringArray, weight: np.ndarray, rows: Rows, ids, label, stands, base: float, size: int, k: int):
        self.terms, self.weight, self.rows, self.base, self.size, self.k = Terms(names), weight, rows, base, size, k
        self.ids, self.label, self.stands = ids, label, stands
        n, known, same = len(rows), {}, []
        for i, (a, b) in enumerate(zip(rows.begin[:-1].tolist(), rows.begin[1:].tolist())):
            whole = hashlib.blake2b(rows.term[a:b].tobytes() + b"|" + rows.value[a:b].tobytes()).digest()
            same.append(known.setdefault(whole, i))
        self.same = np.array(same, np.int64)
        having = np.bincount(rows.term, minlength=len(weight))
        often = np.flatnonzero(having > n / 10)
        self.column = np.full(len(weight), -1, np.int64)
        self.column[often] = np.arange(len(often))
        example, column = np.repeat(np.arange(n), np.diff(rows.begin)), self.column[rows.term]
        rare = column < 0
        self.columns = np.zeros((n, len(often)), np.float32)
        self.columns[example[~rare], column[~rare]] = rows.value[~rare]
        self.starts = np.arange(0, n, size)
        self.bounds = np.maximum.reduceat(self.columns, self.starts, axis=0) if n else self.columns
        order = np.argsort(rows.term[rare], kind="stable")
        self.at, self.rare = example[rare][order], rows.value[rare][order].astype(np.float32)
        self.begin = np.concatenate([[0], np.cumsum(np.where(self.column < 0, having, 0))])

    def vectors(self, texts: Sequence[str]) -> Rows:
        return weighed(*self.terms.counted(texts), self.weight)

    def nearest(self, rows: Rows, without: Sequence[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of some vectors, numbers and similarities (to twelve digits) of the ``k`` nearest examples with any term in
        common; ties go to the first. ``without``: an example that each leaves out.

        Blocks are scored for the vectors whose bound in them reaches the ``k``-th best so far."""
        n, many = len(self.rows), len(rows)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * many
        owner, column = np.repeat(np.arange(many), np.diff(rows.begin)), self.column[rows.term]
        often = np.zeros((many, self.columns.shape[1]), np.float32)
        often[owner[column >= 0], column[column >= 0]] = rows.value[column >= 0]
        term, value, owner = (x[column < 0] for x in (rows.term, rows.value.astype(np.float32), owner))
        sizes = self.begin[term + 1] - self.begin[term]
        place = _spans(self.begin[term], sizes)
        key = self.at[place] + np.repeat(owner * n, sizes)
        near = np.bincount(key, self.rare[place] * np.repeat(value, sizes), many * n).astype(np.float32).reshape(many, n)
        if without is not None:
            near[np.arange(many), without] = -9

        def reached() -> np.ndarray:
            return np.partition(near, n - self.k, axis=1)[:, n - self.k] - SLACK if n > self.k else np.full(many, -8.0)

        bound = np.maximum.reduceat(near, self.starts, axis=1) + often @ self.bounds.T
        least, order = reached(), np.argsort(-bound.max(0), kind="stable")
        for number, block in enumerate(order.tolist()):
            if number == max(1, len(order) // 8):
                least = reached()
            live = np.flatnonzero(bound[:, block] >= least - SLACK)
            part = slice(block * self.size, (block + 1) * self.size)
            if len(live) == many:
                near[:, part] += often @ self.columns[part].T
            elif len(live):
                near[live, part] += often[live] @ self.columns[part].T
        least, query = reached(), np.zeros(len(self.weight))
        hopeful = (near > 0) & (near >= (least - SLACK)[:, None])
        return [self._exact(rows.part(i, i + 1), np.flatnonzero(hopeful[i]), query) for i in range(many)]

    def _exact(self, row: Rows, some: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of ``some`` examples, in full; like examples are scored once. ``query``: zeros, left so."""
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0)
        firsts, which = np.unique(self.same[some], return_inverse=True)
        begin, query[row.term] = self.rows.begin, row.value
        score = np.array([self.rows.value[begin[i] : begin[i + 1]] @ query[self.rows.term[begin[i] : begin[i + 1]]] for i in firsts.tolist()])
        query[row.term] = 0
        score = np.round(score, 12)[which]
        some, score = some[score > 0], score[score > 0]
        order = np.lexsort((some, -score))[: self.k]
        return some[order], score[order]

    def votes(self, rows: Rows, without: Sequence[int] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """The share of label 1 among the nearest of each, by similarity and by the rows that each stands for, with one
        more vote for the share among texts without terms; and the nearest."""
        each = self.begin[rows.term + 1] - self.begin[rows.term]
        sizes, first = np.concatenate([[0], np.cumsum(each)])[rows.begin], 0
        while first < len(rows):
            most = int(np.searchsorted(sizes, sizes[first] + POSTINGS, "right")) - 1
            last = min(max(first + 1, most), first + AT_ONCE, len(rows))
            for at, near in self.nearest(rows.part(first, last), None if without is None else without[first:last]):
                each = near * self.stands[at]
                yield float((each @ self.label[at] + 0.1 * self.base) / (each.sum() + 0.1)), at, near
            first = last

    def common(self, terms: np.ndarray, at: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Those of the terms that any of these examples has. ``seen``: a false for each term, left so."""
        begin = self.rows.begin
        held = [self.rows.term[begin[i] : begin[i + 1]] for i in at.tolist()]
        for own in held:
            seen[own] = True
        found = terms[seen[terms]]
        for own in held:
            seen[own] = False
        return found


@dataclass
class Packed:
    """What an index is built of, as workers get it: arrays of the examples' entries, nothing built."""

    digest: str
    data: bytes

    @classmethod
    def of(cls, *parts) -> Packed:
        data = zlib.compress(pickle.dumps(parts, 5), 1)
        return cls(hashlib.sha256(data).hexdigest(), data)

    def index(self) -> Index:
        """Built once in a worker and kept between tasks."""
        return resident(("toxicity", self.digest), self.build)

    def build(self) -> Index:
        names, weight, begin, steps, n, *rest = pickle.loads(zlib.decompress(self.data))
        rows = weighed(begin, np.cumsum(steps, dtype=np.int64), n.astype(np.int64), weight)
        return Index(names, weight, rows, *rest)


def calibrate(shares: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by weighted logistic regression with a weak pull towards leaving votes as they are."""
    x, y, at = np.log(shares / (1 - shares)), label.astype(float), np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - y)) + (at - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2)
        at = at - np.linalg.solve(curve, slope)
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def calibrated(share: float, slope: float, shift: float) -> float:
    """A vote as a probability: the logistic function of a rising line of its log odds."""
    return float(1 / (1 + np.exp(-np.clip(slope * np.log(share / (1 - share)) + shift, -30, 30))))


def pack_index(found: DataFrame, k: int, block: int, least: float) -> tuple[Packed, list[int]]:
    """The index of stored examples (``slot``, ``doc_id``, ``text``, ``label``, ``weight``), and the slots of its rows: Spark counts, numbers and sorts their terms; the
    driver gets the entries of the bounded sample as arrays, to send them to the workers."""
    counted = materialize(with_terms(found), "toxicity-counts")
    chosen = vocabulary(counted, least)
    entries = counted.select("slot", F.explode("terms").alias("term", "n")).join(chosen, "term")
    own = F.sort_array(F.collect_list(F.struct(F.col("number").cast("int").alias("at"), F.col("n").cast("int").alias("n"))))
    lists = entries.groupBy("slot").agg(own.alias("own"), F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("number").cast("int").alias("at")))).alias("heavy"))
    kept = counted.select("slot", "doc_id", "label", "weight").join(lists, "slot", "left")
    heavy = F.transform("heavy", lambda x: x["at"])  # like vectors share blocks
    rows = kept.select("slot", "doc_id", "label", "weight", F.col("own.at").alias("at"), F.col("own.n").alias("n"), heavy.alias("heavy"))
    rows = rows.orderBy("heavy", "doc_id", "slot").drop("heavy").toArrow()
    ids, label, stands = (rows.column(name).to_numpy() for name in ("doc_id", "label", "weight"))
    at, n = (rows.column(name).combine_chunks() for name in ("at", "n"))
    sizes = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    every, seen = ([stands[of & (label == c)].sum() for c in (0, 1)] for of in (sizes >= 0, sizes == 0))
    share = (every[1] + 0.5) / (sum(every) + 1 + (not len(ids)))  # a third without examples
    base = float((seen[1] + share) / (sum(seen) + 1))
    names = chosen.orderBy("number").select("term", "weight").toArrow()
    terms, weight = names.column("term").combine_chunks().cast(pa.string()), names.column("weight").to_numpy()
    some = sizes > 0
    flat, n = (x.flatten().to_numpy().astype(np.int32) for x in (at, n))
    begin = np.concatenate([[0], np.cumsum(sizes[some])])
    packed = Packed.of(terms, weight, begin, np.diff(flat, prepend=0), n, ids[some], label[some], stands[some], base, block, k)
    return packed, rows.column("slot").to_numpy()[some].tolist()


def build_index(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, k: int, block: int, least: float
) -> tuple[Packed, float, float]:
    """The index over at most ``most`` examples of each class and all their terms, and the slope and shift of its votes, fitted
    to a table of the examples' own votes."""
    found = numbered(examples(docs, labels, label, train, most), "toxicity-examples")  # documents are scanned once
    packed, slots = pack_index(found, k, block, least)
    sent = found.sparkSession.sparkContext.broadcast(packed)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.index()
        places = {slot: place for place, slot in enumerate(slots)}
        for batch in batches:
            some = [i for i, x in enumerate(batch.column(0).to_pylist()) if x in places]
            part = batch.take(pa.array(some, pa.int64()))
            without = [places[x] for x in part.column(0).to_pylist()]
            shares = [share for share, _, _ in index.votes(index.vectors(part.column(1).to_pylist()), without)]
            yield pa.RecordBatch.from_arrays([pa.array(shares, pa.float64()), *part.columns[2:]], ["share", "label", "weight"])

    rows = small_batches(found, 512).select("slot", "text", "label", "weight")
    voted = rows.mapInArrow(vote, "share double, label int, weight double").orderBy("share", "label", "weight").toArrow()  # three numbers an example
    figures = [voted.column(name).to_numpy() for name in ("share", "label", "weight")]
    return packed, *(calibrate(*figures) if len(figures[0]) else (1.0, 0.0))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    keep: Sequence[str] = ("doc_id",),
    label: str = "toxic",
    threshold: float = 0.7,
    most: int = 2_000,
    k: int = 8,
    block: int = 256,
    least: float = 16.0,
) -> DataFrame:
    """The columns ``keep``, ``score`` (0 to 1, higher: ``label`` 1 likelier), ``predicted`` (1 from ``threshold``),
    ``evidence`` (the ``k`` nearest examples, nearest first) and ``matched`` (the terms shared with any of them, in order).

    Only the text makes a score. At most ``most`` labelled documents of each class that satisfy ``train`` are examples;
    all terms that two of their families have are looked up, and every document's whole text, however long, is scored. A text
    without any of the terms, also a null or empty one, gets the share of label 1 among such examples, or without such examples
    among all. Without labels of both classes all scores are that share, or a third without any. A document labelled both ways
    counts as 1. Every row of ``docs`` gives a row, repeated ones each; an empty table gives none; columns that aren't kept
    aren't read, and those kept may have any name but the four.
    """
    packed, slope, shift = build_index(small_batches(docs), labels, label, train, most, k, block, least)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def score(data: np.ndarray, offsets: np.ndarray) -> dict[str, pa.Array]:
        index = sent.value.index()
        rows = index.vectors([str(data[a:b].data, "utf-8") for a, b in zip(offsets[:-1], offsets[1:])])
        scores, seen = [], np.zeros(len(index.weight), bool)
        found, near, shared = [], [], []
        for i, (share, at, close) in enumerate(index.votes(rows)):
            terms = rows.term[rows.begin[i] : rows.begin[i + 1]]
            scores.append(calibrated(share if len(terms) else index.base, slope, shift))
            found.append(at), near.append(close), shared.append(index.common(terms, at, seen))
        at = np.concatenate([*found, np.zeros(0, np.int64)])
        proof = pa.StructArray.from_arrays(
            [pa.array(index.ids[at], pa.int64()), pa.array(index.label[at], pa.int32()), pa.array(np.concatenate([*near, np.zeros(0)]), pa.float64())],
            ["doc_id", "label", "similarity"],
        )
        terms = index.terms.names.take(pa.array(np.concatenate([*shared, np.zeros(0, np.int64)])))
        ends = [np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int32) for of in (found, shared)]
        return {
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
            "evidence": pa.ListArray.from_arrays(ends[0], proof),
            "matched": pa.ListArray.from_arrays(ends[1], terms),
        }

    made = (
        "score double, predicted int, evidence array<struct<doc_id:bigint,label:int,similarity:double>>, "
        "matched array<string>"
    )
    return with_scores(docs, keep, made, score)
