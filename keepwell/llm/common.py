"""What the operators of this package share: words, tables, unique row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.session import materialize, prepare

#: ASCII white space ends a word, nothing else does.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed collection of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_text(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def numbered(df: DataFrame, label: str, name: str = "slot") -> DataFrame:
    """A stored copy of ``df`` with a unique number per row; stored, so that a repeated task can't renumber."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), label)


def small_batches(df: DataFrame, most: int = 1000) -> DataFrame:
    """``df``, with at most ``most`` rows to an Arrow batch from now on in its session.

    A batch is held by the JVM and by Python at once, so its rows, not their bytes, decide how much memory a task needs;
    the default of 10,000 rows is for narrow ones.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if not 0 < now <= most:
        df.sparkSession.conf.set(name, str(most))
    return df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, end to end, and where each begins and the last one ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``most`` bytes each, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


#: What this worker keeps between tasks.
KEPT: dict = {}


def resident(key, make):
    """What ``make`` returns, kept in the worker between tasks until another key comes: workers go on from one operator to
    the next, and what each of them has learned wouldn't fit in memory together."""
    if key not in KEPT:
        KEPT.clear()
        pa.default_memory_pool().release_unused()
        KEPT[key] = make()
    return KEPT[key]


class Generations(dict):
    """A cache of bounded size: a full generation becomes the old one, from which what is still used moves on."""

    def __init__(self, make, most: int, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
