"""Byte-pair encoding and decoding as a tokenizer file says.

A word starts as one token per byte. A segment tree over the ranks of its adjacent pairs has, at its root, the leftmost
pair of the lowest rank; it is merged, and the pairs beside it get their new ranks by point updates of logarithmic cost,
until no pair is mergeable. So a word of n bytes takes n log n steps, also one without any space that fills a text. The trees
of all new words of like length are kept in one array and go on together, a merge of each word at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.common import resident, small_batches, whole_text

#: The rules of the tokenizer files that this module reads.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: More than any rank times any length.
NEVER = 1 << 62
#: Words of more tokens have a tree of their own; others share arrays of so many words.
LONG, TOGETHER = 129, 8192

DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """Ranks of pairs of token ids, and the token that each rank makes."""

    def __init__(self, pairs: Sequence[tuple[int, int]], made: Sequence[int]):
        codes = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks, self.made = np.append(codes[order], NEVER), np.append(order, 0), np.array(made, np.int64)
        self.rank = dict(zip(codes.tolist(), range(len(codes))))

    def keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        """Rank times ``length`` plus ``place`` of each pair; NEVER where it isn't mergeable. Ids under 0 are none."""
        codes = a << 32 | b
        at = np.searchsorted(self.codes, codes)
        return np.where((self.codes[at] == codes) & (a >= 0) & (b >= 0), self.ranks[at] * length + place, NEVER)

    def apply(self, ids: list[int]) -> list[int]:
        """The ids of one word that are left when no adjacent pair is mergeable any more."""
        n = len(ids)
        if n < 2:
            return ids
        rank, made, ids = self.rank, self.made, list(ids)
        size = 1 << (n - 2).bit_length()
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            found = rank.get(ids[i] << 32 | ids[i + 1])
            if found is not None:
                tree[size + i] = found * n + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(left: int, right: int) -> None:
            """The pair that starts at ``left`` is the one with ``right`` now; beyond the end there is none."""
            found = rank.get(ids[left] << 32 | ids[right]) if right < n else None
            node = size + left
            if node == 2 * size:  # the last token starts no pair
                return
            tree[node] = NEVER if found is None else found * n + left
            while node > 1:
                least = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < NEVER:
            which, left = divmod(tree[1], n)
            gone = after[left]
            right = after[gone]
            ids[left], after[left] = int(made[which]), right
            if right < n:
                before[right] = left
            put(gone, n)
            ids[gone] = -1
            put(left, right)
            if before[left] >= 0:
                put(before[left], left)
        return [x for x in ids if x >= 0]

    def apply_together(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``apply`` of many words, a row each, of ``sizes`` tokens; what is left of a row has gaps of -1."""
        words, length = ids.shape
        size = length - 1  # a power of two
        tree = np.full((words, 2 * size), NEVER, np.int64)
        tree[:, size:] = self.keys(ids[:, :-1], ids[:, 1:], np.arange(size), length)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        after, before = (np.tile(np.arange(length) + step, (words, 1)) for step in (1, -1))
        live = np.arange(words)
        while True:
            least = tree[live, 1]
            live, least = live[least < NEVER], least[least < NEVER]
            if not len(live):
                return ids
            which, left = np.divmod(least, length)
            gone = after[live, left]
            right = after[live, gone]
            ids[live, left], after[live, left], ids[live, gone] = self.made[which], right, -1
            inner = right < sizes[live]
            before[live[inner], right[inner]] = left[inner]
            first = before[live, left]
            later, earlier = np.where(inner, ids[live, np.minimum(right, size)], -1), np.where(first >= 0, ids[live, first], -1)
            here = ids[live, left]
            rows, leaf = np.concatenate([live, live, live]), np.concatenate([gone, left, np.where(first >= 0, first, left)])
            own = self.keys(here, later, left, length)
            keys = np.concatenate([np.full(len(live), NEVER), own, np.where(first >= 0, self.keys(earlier, here, first, length), own)])
            rows, leaf, keys = (x[leaf < size] for x in (rows, leaf, keys))
            node = leaf + size
            tree[rows, node] = keys
            while size > 1 and node.size and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


class Bpe:
    """A tokenizer file with word ends: its rules, its merges, and the texts of its tokens.

    Its rules take a text apart into words, digits and runs of signs, and encode each on its own, so what is made of a part is
    kept. Text of plain Latin signs is taken apart here, by the file's pattern; any other run between spaces or line breaks
    is normalised and taken apart by the file's own rules. A file with other rules is an error.
    """

    #: Signs for which Python's lower case and letters are surely those of the file's rules, and what is not of them.
    PLAIN, ODD = re.compile("[!-~\u00a1-\u024f]+"), re.compile(r"[^ \n!-~\u00a1-\u024f]|<\|")
    #: The pattern for plain text: its letters, its numbers, its signs.
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\s\w]|_)+")

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        splits = [p.get("pattern", {}).get("Regex") for p in rules["pre_tokenizer"]["pretokenizers"]]
        if rules["normalizer"]["normalizers"] != NORMALIZERS or splits != [PARTS, None] or rules["decoder"] is not None:
            raise ValueError(f"{path} has rules that this encoder doesn't know")
        if model["type"] != "BPE" or model["unk_token"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} has a model that this encoder doesn't know")
        whole = Tokenizer.from_file(path)
        self.normal, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")" if self.special else "(?!)")
        self.texts = {i: text for text, i in (ids | self.special).items()}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        signs = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.bytes = {sign: b for b, sign in signs.items()}
        self.first = np.array([ids[signs[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[signs[b] + end] for b in range(256)], np.int64)
        self.most = most
        self.forget()

    def forget(self) -> None:
        """No part is known but the special tokens: its ids in decimal, and its decoded text, each joined by spaces."""
        self.ids_of = {i: str(i).encode() for i in self.special.values()}
        self.text_of = {i: text.encode() for text, i in self.special.items()}

    def parts(self, text: str) -> list[str | bytes | int]:
        """The parts of a text: plain ones as they are, others as bytes, special tokens as their ids."""
        if not self.ODD.search(text):
            return self.SPLIT.findall(text.lower())
        found: list[str | bytes | int] = []
        for run in text.replace("\n", " ").split(" "):
            if not self.ODD.search(run):
                found += self.SPLIT.findall(run.lower())
                continue
            for number, piece in enumerate(self.special_parts.split(run)):
                if number % 2:
                    found.append(self.special[piece])
                elif piece:
                    found += [bytes(map(self.bytes.__getitem__, part)) for part, _ in self.split(self.normal(piece))]
        return found

    def merged(self, words: Sequence[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The number of each word and its ids, words of like length together."""
        classes: dict[int, list[int]] = {}
        for number, word in enumerate(words):
            n = len(word)
            if n > LONG:
                ids = self.first[np.frombuffer(word, np.uint8)].tolist()
                yield number, self.merges.apply([*ids[:-1], int(self.last[word[-1]])])
            else:
                classes.setdefault(1 << max(0, n - 2).bit_length(), []).append(number)
        for size, numbers in classes.items():
            for at in range(0, len(numbers), TOGETHER):
                some = [words[i] for i in numbers[at : at + TOGETHER]]
                flat = np.frombuffer(b"".join(some), np.uint8)
                sizes = np.fromiter(map(len, some), np.int64, len(some))
                ids = np.full((len(some), size + 1), -1, np.int64)
                ids[np.arange(size + 1) < sizes[:, None]] = self.first[flat]
                ids[np.arange(len(some)), sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
                left = self.merges.apply_together(ids, sizes)
                ends = np.cumsum((left >= 0).sum(axis=1)).tolist()
                rest = left[left >= 0].tolist()
                yield from zip(numbers[at : at + TOGETHER], (rest[a:b] for a, b in zip([0, *ends], ends)))

    def learn(self, parts: Iterable[str | bytes | int]) -> None:
        """The ids and the texts of parts that aren't known yet."""
        if len(self.ids_of) > self.most:
            self.forget()
        new = list(set(parts).difference(self.ids_of))
        for number, ids in self.merged([p.encode() if p.__class__ is str else p for p in new]):
            self.ids_of[new[number]] = " ".join(map(str, ids)).encode()
            self.text_of[new[number]] = self.decode(ids).encode()

    def windows(self, texts: Sequence[str], at_once: int = 1 << 20) -> Iterator[list[tuple[int, list]]]:
        """The parts of about ``at_once`` signs at a time, all learned, by the texts' numbers. Long texts go in several."""
        found, size = [], 0
        for number, text in enumerate(texts):
            start = 0
            while start < len(text):
                end = min(start + at_once, len(text))
                if end < len(text):
                    cut = [i for i in (text.find(" ", end), text.find("\n", end)) if i >= 0]
                    end = min(cut, default=len(text))
                found.append((number, self.parts(text[start:end])))
                size, start = size + end - start, end
                if size >= at_once:
                    self.learn(p for _, parts in found for p in parts)
                    yield found
                    found, size = [], 0
        self.learn(p for _, parts in found for p in parts)
        yield found

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for window in self.windows(texts):
            for number, parts in window:
                out[number] += map(int, b" ".join(map(self.ids_of.__getitem__, parts)).split())
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The file has no decoder, so a text is its tokens' own texts, joined by spaces; unknown ids have none."""
        return " ".join([text for text in map(self.texts.get, ids) if text is not None])

    def digests(self, texts: Sequence[str]) -> list[tuple[int, str, str]]:
        """The number of tokens, and the SHA-256 of the ids in decimal and of the decoded text, both joined by spaces."""
        own = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        for window in self.windows(texts):
            for number, parts in window:
                if parts:
                    at = own[number]
                    between, ids = b" " if at[0] else b"", b" ".join(map(self.ids_of.__getitem__, parts))
                    at[1].update(between + ids)
                    at[2].update(between + b" ".join(map(self.text_of.__getitem__, parts)))
                    at[0] += ids.count(b" ") + 1
        return [(n, ids.hexdigest(), text.hexdigest()) for n, ids, text in own]


def encoder(path: str) -> Bpe:
    return resident(("bpe", path), lambda: Bpe(path))


def _with(docs: DataFrame, keep: Sequence[str], given: str, made: str, make) -> DataFrame:
    """The columns ``keep`` and what ``make`` returns, a tuple each, for some values of the column ``given``."""
    rows, at = small_batches(docs).select(*keep, given), len(keep)
    new = T._parse_datatype_string(made)
    full = T.StructType([*rows.schema.fields[:at], *new.fields])
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() if f.dataType == T.StringType() else pa.list_(pa.int32()) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values = zip(*make(part.column(at).to_pylist()))
                columns = [pa.array(list(v), k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *columns], [f.name for f in full.fields])

    return rows.mapInArrow(run, full)


def encode_documents(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of each whole ``text``; a null or empty text has none."""
    rows = docs.select(*keep, whole_text(text).alias("_text"))
    return _with(rows, keep, "_text", "ids array<int>", lambda texts: [(ids,) for ids in encoder(tokenizer).encode(texts)])


def decode_ids(encoded: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``text``, the decoded text of the array ``ids``, special tokens included; null is empty."""
    rows = encoded.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    return _with(rows, keep, "_ids", "text string", lambda lists: [(encoder(tokenizer).decode(x or []),) for x in lists])


def encoding_digests(docs: DataFrame, tokenizer: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_tokens``, and the SHA-256 of each whole text's ids (in decimal, joined by one space) and of
    its decoded text.

    A null or empty text, or one of white space, has no tokens. Texts of any length are read a megabyte at a time. Every row
    gives a row, repeated rows each, also one without an id; no documents give no rows. Other columns aren't read.
    """
    rows = docs.select(*keep, whole_text().alias("_text"))
    return _with(rows, keep, "_text", DIGESTS, lambda texts: encoder(tokenizer).digests(texts))
