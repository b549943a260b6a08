"""Scores of whole texts, computed in Arrow batches next to the columns they came with."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwell.llm.common import runs, small_batches, utf8, whole_text

Scorer = Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]]


def with_scores(docs: DataFrame, keep: Sequence[str], schema: str, scorer: Scorer, most: int = 1 << 20) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those that ``scorer`` makes of about ``most`` bytes of texts at a time.

    ``scorer`` takes the texts' UTF-8 bytes, end to end, and where each begins and the last one ends.
    """
    own = "text" in keep
    rows = small_batches(docs).select(*keep) if own else docs.select(*keep, whole_text().alias("text"))
    made, at_text = T._parse_datatype_string(schema), rows.columns.index("text")
    full = T.StructType([*rows.schema.fields[: len(keep)], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at_text))
            for first, last in runs(offsets, most):
                part = batch.slice(first, last - first)
                at = offsets[first : last + 1]
                new = scorer(data[at[0] : at[-1]], at - at[0])
                columns = [*part.columns[: len(keep)], *(new[f.name] for f in made.fields)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in full.fields])

    return rows.mapInArrow(run, full)


def remainder_is(doc_id: Column, divisor: int, rest: int) -> Column:
    """Whether the CRC-32 of an id's text leaves this remainder; a null id's doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % divisor == rest, F.lit(False))
