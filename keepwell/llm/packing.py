"""Packing documents into sequences of bounded length: tokens of each text, cut into pieces, packed by best fit.

Pieces of a group go online into a fixed number of open bins, each into the open bin with the least space that
is enough. A bitset with a bit per amount of free space finds it. When too many bins are open, the fullest closes.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import Generations, resident, small_batches, whole_text
from keepwell.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer file's own encoding.

    The file's rules split at white space and encode what is between on its own, so ids are looked up per run
    between spaces or line breaks. A new run of plain Latin signs is split by the file's own pattern and
    its parts go to the file's model; any other run goes through the tokenizer as a whole.
    """

    #: Fixed value: how the tokenizer file splits a normalised text.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    PLAIN = re.compile("[!-~¡-ɏ]+")

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.parts = Generations(self._part, most // 2)
        self.runs = Generations(self._run, most)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(self.signs[b] for b in part.encode())
        return packed([token.id for token in self.model.tokenize(part)])

    def _run(self, run: str) -> bytes:
        if not self.PLAIN.fullmatch(run) or "<|" in run:
            return packed(self.tokenizer.encode(run, add_special_tokens=False).ids)
        normal = (run if run.isascii() else unicodedata.normalize("NFC", run)).lower()
        if normal.isalpha():
            return self.parts[normal]
        return b"".join(map(self.parts.__getitem__, self.PARTS.findall(normal)))

    def encode(self, text: str, at_once: int = 1 << 20) -> Iterator[bytes]:
        """The ids of a text, a megabyte or so of it at a time."""
        start = 0
        while start < len(text):
            end = start + at_once
            if end < len(text):
                cut = [i for i in (text.find(" ", end), text.find("\n", end)) if i >= 0]
                end = min(cut, default=len(text))
            runs = text[start:end].replace("\n", " ").split(" ")
            yield b"".join(map(self.runs.__getitem__, filter(None, runs)))
            start = end


def tokens(path: str) -> Tokens:
    return resident(("tokens", path), lambda: Tokens(path))


def pieces(parts: Iterable[bytes], most: int) -> Iterator[tuple[int, int, int]]:
    """start, length and CRC-32 of the pieces of a document's ids; all but the last have ``most`` ids."""
    start, rest, full = 0, b"", 4 * most
    for part in parts:
        rest += part
        while len(rest) > full:
            yield start, most, zlib.crc32(rest[:full])
            start, rest = start + most, rest[full:]
    yield start, len(rest) // 4, zlib.crc32(rest)


def best_fit(lengths: Iterable[int], most: int, bins: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in turn; at most ``bins`` bins are open."""
    free, by_free, n_open, used, out = 0, {}, 0, 0, []
    for length in lengths:
        fits = free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = by_free[space].pop()
            if not by_free[space]:
                free ^= 1 << space
            n_open -= 1
        else:
            space, bin_, used = most, used, used + 1
        out.append((bin_, most - space))
        if space > length:
            space -= length
            by_free.setdefault(space, []).append(bin_)
            free |= 1 << space
            n_open += 1
            if n_open > bins:
                fullest = (free & -free).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free ^= 1 << fullest
                n_open -= 1
    return out


def token_pieces(docs: DataFrame, tokenizer: str, most: int, end: int) -> DataFrame:
    """The pieces of each document, stored, with a number per piece in ``slot``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = tokens(tokenizer), packed([end])
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256), []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    parts = chain(known.encode(text), (last,))
                    out += [(doc_id, i, *piece) for i, piece in enumerate(pieces(parts, most))]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(cut, PIECES)
    return materialize(rows.withColumn("slot", F.monotonically_increasing_id()), "pieces")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    most: int = 4096,
    end: int = 1,
    bins: int = 256,
    per_group: int = 50_000,
) -> DataFrame:
    """Places for all tokens of all documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A document is its text's ids by the ``tokenizer`` file and then ``end``, so a null or empty text still has
    one token. Documents over ``most`` tokens are cut into pieces of ``most``. The pieces are dealt by a hash of their
    row number into groups of about ``per_group`` rows, whatever their documents, sources or copies; each group is
    packed on its own, online, with ``bins`` open bins, in the order of that hash. Numbers of sequences have gaps.
    Repeated rows are packed each; a document without an id keeps a null one; no documents give no rows.
    """
    stored = token_pieces(docs, tokenizer, most, end)
    groups = max(1, -(-stored.count() // per_group))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "slot"])
        bin_, offset = zip(*best_fit(rows["length"].tolist(), most, bins))
        rows = rows.assign(sequence_id=rows["group"] * (1 << 32) + list(bin_), offset=list(offset))
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype(
            {"doc_id": "Int64"}
        )

    order = F.xxhash64("slot")
    dealt = stored.withColumn("order", order).withColumn("group", F.pmod("order", F.lit(groups)).cast("bigint"))
    return dealt.groupBy("group").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")
