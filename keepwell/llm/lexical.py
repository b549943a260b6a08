"""Ranked lexical search by hashed max-sketches.

The index has a row per document: its terms and how often each comes, and a sketch, in which each term falls into one
coordinate of either of two rows of hashes, and a coordinate keeps the largest count that fell into it. A term's impact in a
document rises with its count, so the sketch bounds the impact of any term from above, by the smaller of its two coordinates.
A search looks the terms of a block of queries up in the sketches of a batch of documents at once; the weighted sums bound
the scores. Documents are then scored exactly in the order of their bounds until the bound can't reach a query's best any more.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.common import small_batches, utf8, whole_text
from keepwell.session import materialize, scratch_path

#: What ends a term, ASCII signs other than letters and digits, becomes a space; A to Z become small.
SIGNS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: An odd factor that makes the second hash from the first.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Coordinates of a sketch row per term, at least; counts over the largest byte are kept as it.
ROOM, LEAST, FULL = 4, 64, 255
#: Fixed values of the score: the impact of a count without end, and more than the error of sums in single precision.
CEILING, SLACK = 1e6, 1 + 1e-4

INDEX = "doc_id long, n long, width int, sketch binary, terms binary, counts binary"


def split_terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


def coordinates(hashes: np.ndarray, width) -> tuple[np.ndarray, np.ndarray]:
    """Where terms of these 32-bit hashes fall in either row of a sketch; ``width``, a power of two, may be an array."""
    mask = np.asarray(width, np.uint64) - np.uint64(1)
    return (hashes & mask).astype(np.int64), (((hashes * ODD) >> np.uint64(40)) & mask).astype(np.int64)


def hashed(terms: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), np.uint64, len(terms))


def sketches(sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of documents of ``sizes[i]`` terms each, end to end, and the width of each one's rows."""
    width = np.maximum(LEAST, 1 << np.ceil(np.log2(np.maximum(sizes, 1) * ROOM)).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(2 * width)])
    flat = np.zeros(begin[-1], np.uint8)
    each, start = np.repeat(width, sizes), np.repeat(begin[:-1], sizes)
    order = np.argsort(counts, kind="stable")  # where several fall together, the largest count is written last
    capped = np.minimum(counts, FULL).astype(np.uint8)[order]
    first, second = coordinates(hashes, each)
    flat[(start + first)[order]] = capped
    flat[(start + each + second)[order]] = capped
    return flat, width


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all documents with at least one term: ``doc_id``, ``n`` (terms with repeats), ``width``,
    ``sketch``, ``terms`` (each once, joined by spaces) and ``counts``. It knows of no query and serves any."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = utf8(part.column(1))
                found = [Counter(split_terms(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:])]
                some = [i for i, counter in enumerate(found) if counter]
                if not some:
                    continue
                sizes = np.array([len(found[i]) for i in some])
                flat = [term for i in some for term in found[i]]
                counts = np.array([n for i in some for n in found[i].values()], np.int64)
                sketch, width = sketches(sizes, hashed(flat), counts)
                ends, own = np.cumsum(sizes), np.concatenate([[0], np.cumsum(2 * width)])
                spans = list(zip(ends - sizes, ends))
                columns = [
                    part.column(0).take(pa.array(some)),
                    pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()),
                    pa.array(width, pa.int32()),
                    pa.array([sketch[a:b].tobytes() for a, b in zip(own[:-1], own[1:])], pa.binary()),
                    pa.array([b" ".join(flat[a:b]) for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "width", "sketch", "terms", "counts"])

    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(make, INDEX)
    path = scratch_path(docs.sparkSession, "lexical-index")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class Block:
    """Some queries: their ids, their terms' numbers and hashes, and the terms' weights per query."""

    ids: list
    number: dict[bytes, int]
    weights: np.ndarray
    documents: int
    length: int

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * counts) // (1000 * counts + 8 * self.damping(n))

    def damping(self, n: np.ndarray) -> np.ndarray:
        return np.array([100 - 90 + (90 * int(x) * self.documents) // self.length for x in n], np.int64)

    def bounds(self, sketch: np.ndarray, width: int, n: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No less than the score of each of these documents (rows), whose sketches are ``width`` wide, for each query."""
        first, second = coordinates(hashes, width)
        most = np.minimum(sketch[:, first], sketch[:, width + second])
        counts, damping = most.astype(np.float32), self.damping(n).astype(np.float32)[:, None]
        impact = np.float32(1e9) * counts / np.maximum(np.float32(1000) * counts + np.float32(8) * damping, 1)
        impact[most == FULL] = CEILING
        return (impact @ weights) * np.float32(SLACK)

    def exact(self, terms: bytes, counts: bytes, n: int) -> np.ndarray:
        """The score of a document for each query."""
        numbers = [self.number.get(t, -1) for t in terms.split(b" ")]
        at = np.array(numbers, np.int64)
        known = at >= 0
        own = np.frombuffer(counts, "<u4").astype(np.int64)[known]
        return self.weights[:, at[known]] @ self.impacts(own, np.array([n]))


class Best:
    """The best documents so far of each query of a block: the highest scores, ties to the lowest ids, null ids last."""

    def __init__(self, queries: int, most: int):
        self.heaps, self.most = [[] for _ in range(queries)], most
        self.least = np.zeros(queries)

    def offer(self, query: int, score: int, doc_id: int | None) -> None:
        entry, heap = (score, doc_id is not None, -(doc_id or 0)), self.heaps[query]
        if len(heap) < self.most:
            heappush(heap, entry)
        elif entry > heap[0]:
            heapreplace(heap, entry)
        if len(heap) == self.most:
            self.least[query] = heap[0][0]


def _search_batch(block: Block, best: Best, batch: pa.RecordBatch, hashes: np.ndarray, weights: np.ndarray) -> None:
    ids, n, widths = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
    sketch, terms, counts = (batch.column(i) for i in (3, 4, 5))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        step = max(1, (1 << 24) // max(2 * width, 4 * len(hashes), 1))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            raw = b"".join(sketch[i].as_buffer() for i in part.tolist())
            bound = block.bounds(np.frombuffer(raw, np.uint8).reshape(len(part), -1), width, n[part], hashes, weights)
            hopeful, scored = (bound > 0) & (bound >= best.least), {}
            for query in np.flatnonzero(hopeful.any(axis=0)).tolist():
                own = np.flatnonzero(hopeful[:, query])
                for i in own[np.argsort(-bound[own, query], kind="stable")].tolist():
                    if bound[i, query] < best.least[query]:
                        break
                    if i not in scored:
                        at = int(part[i])
                        scored[i] = block.exact(terms[at].as_py(), counts[at].as_py(), int(n[at]))
                    score = int(scored[i][query])
                    if score > 0:
                        best.offer(query, score, ids[int(part[i])])


def _blocks(items: DataFrame, at_once: int) -> Iterator[dict]:
    """The items' ids, in order, with their terms; ``at_once`` items at a time. Rows of one id are one item."""
    found: dict = {}
    rows = items.select("item_id", whole_text().alias("text")).filter("item_id is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if row["item_id"] not in found and len(found) == at_once:
            yield found
            found = {}
        found.setdefault(row["item_id"], set()).update(split_terms(row["text"].encode()))
    if found:
        yield found


def _document_counts(index: DataFrame, number: dict[bytes, int]) -> np.ndarray:
    """In how many documents each of these terms is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                known = [i for i in map(number.get, terms.split(b" ")) if i is not None]
                total[known] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["at", "n"])

    found = np.zeros(len(number), np.int64)
    for row in index.select("terms").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[row["at"]] = row["n"]
    return found


def search_block(index: DataFrame, found: dict, documents: int, length: int, most: int) -> DataFrame:
    """``item_id``, ``doc_id`` and ``score`` of the best documents of each partition of the index for the items ``found``."""
    number = {term: i for i, term in enumerate(sorted(set().union(*found.values())))}
    having = _document_counts(index, number).tolist()
    weight = [math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * n + 1))) for n in having]
    weights = np.zeros((len(found), len(number)), np.int64)
    for row, terms in enumerate(found.values()):
        for term in terms:
            weights[row, number[term]] = weight[number[term]]
    block = Block(list(found), number, weights, documents, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hashes, floats = Best(len(block.ids), most), hashed(list(block.number)), block.weights.T.astype(np.float32)
        for batch in batches:
            _search_batch(block, best, batch, hashes, floats)
        rows = [(q, i if known else None, s) for q, heap in enumerate(best.heaps) for s, known, i in heap]
        columns = [[q for q, _, _ in rows], [None if i is None else -i for _, i, _ in rows], [s for _, _, s in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "doc_id", "score"])

    return index.mapInArrow(run, "place long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, most: int = 10, at_once: int = 200) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of each item's ``most`` highest-scoring documents of the index.

    Items go ``at_once`` at a time against all documents, so that a block's terms and weights, which tasks get, are bounded.
    Each task scores exactly until no bound reaches its best documents, and the best of all tasks are ranked. Equal scores
    go by ascending ``doc_id``, null last; repeated rows are ranked each. Rows of one ``item_id`` are one item with
    the terms of all; items without an id or terms, and documents without a term of the item, give no rows.
    """
    spark = index.sparkSession
    documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = items.schema["item_id"].dataType
    parts = []
    for found in _blocks(items, at_once) if documents else ():
        if not any(found.values()):
            continue
        best = search_block(index, found, documents, length, most)
        names = spark.createDataFrame(list(enumerate(found)), "place long, item_id " + kind.simpleString())
        parts.append(materialize(best, "lexical-best").join(F.broadcast(names), "place"))
    if not parts:
        empty = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
        return spark.createDataFrame([], empty)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = 10, at_once: int = 200) -> DataFrame:
    """``search`` over an index of all ``docs``. Null and empty texts, or texts without terms, are in no result; no documents
    or no items give no rows; texts of any length are whole; only ``doc_id``, ``text`` and ``item_id`` are read."""
    return search(build_index(docs), items, most, at_once)
