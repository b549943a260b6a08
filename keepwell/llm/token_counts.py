"""Token counts by a unigram vocabulary, without tokens: Aho-Corasick finds the pieces, Viterbi carries score and count.

At each sign the best path's score and number of pieces are kept, no way back. Of paths with equal scores the one whose
last piece begins first stays, which is what the tokenizer does; so the count is that of its own segmentation. Signs
that no piece covers are unknown, cost ten below the least score, and count as their UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import Generations, resident, small_batches, whole_text

#: The sign that stands for a space, and how far below the least score an unknown sign is.
SPACE, PENALTY = "▁", 10.0
SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")
UNKNOWN = 1 << 40


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file that stand for text, with their scores."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    numbers = range(model.get_piece_size())
    plain = [i for i in numbers if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter:
    """Counts of pieces, and ``UNKNOWN`` times the unknown signs, of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 400_000):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        # runs of spaces and what follows can be counted one by one if no piece goes on into a space
        self.apart = all(SPACE not in piece.lstrip(SPACE) for piece, _ in vocabulary)
        self.words = Generations(self._word, most)

    def viterbi(self, signs: str) -> int:
        """The count of a normalised text's best segmentation."""
        n = len(signs)
        best, counts = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in signs]
        for end, piece in self.machine.iter(signs):
            ends[end].append(piece)
        for end, found in enumerate(ends):
            top, count, single = float("-inf"), 0, False
            for length, score in sorted(found, reverse=True):  # the longest begins first, and keeps ties
                single |= length == 1
                score += best[end + 1 - length]
                if score > top:
                    top, count = score, counts[end + 1 - length] + 1
            if not single and best[end] + self.unknown > top:
                top = best[end] + self.unknown
                count = counts[end] + len(signs[end].encode("utf-8", "surrogatepass")) + UNKNOWN
            best[end + 1], counts[end + 1] = top, count
        return counts[n]

    def _word(self, word: str) -> int:
        return self.viterbi(SPACE + word)

    def count(self, text: str) -> tuple[int, int]:
        """How many tokens, and of how many unknown signs, a text has; none if it is empty."""
        if not text:
            return 0, 0
        if not self.apart:
            total = self.viterbi(SPACE + text.replace(" ", SPACE))
        elif "  " in text or SPACE in text or text[0] == " ":
            runs = SPACED.findall(SPACE + text.replace(" ", SPACE))
            total = sum(self.words[run[1:]] for run in runs)
        else:
            total = sum(map(self.words.__getitem__, text.split(" ")))
        return total % UNKNOWN, total // UNKNOWN


def counter(path: str) -> Counter:
    return resident(("counter", path), lambda: Counter(read_vocabulary(path)))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_unknown`` (signs that no piece covers) of each whole text by the unigram
    ``vocabulary``, a sentencepiece file. The text is taken as it is but for a space before it and the sign for spaces.

    A null or empty text has no tokens. Every row of ``docs`` gives a row, repeated ones each, and nothing is shuffled; an
    empty table gives none; other columns aren't read, whatever their names. Texts of any length are counted whole. What a
    task remembers of words is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [own.count(text) for text in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*found))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_unknown"])

    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, n_unknown long")
