"""Readers. None infers a schema."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keepwell.functions.text import unescape_breaks
from keepwell.schemas import COMMENTS, SNAPSHOTS, SUBSCRIBERS

# Where a row stands in its file; compares like the order of lines.
POSITION = ["_file", "_block", "_row"]


class EmptyTable(ValueError):
    """A table that must have rows has none."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A whole Parquet table. Filters and column choices on it reach the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyTable(f"{what} has no rows")
    return df


BROKEN = "_broken"  # the text of a line or record that doesn't fit


FILES_AT_ONCE = 100  # whose first lines one job looks up
SMALL_FILE = 1 << 20  # bytes; such files are many, and each costs more to open than to read


def _headers(spark: SparkSession, path: str, **options) -> list[tuple[list[str], list[str]]]:
    """The names of columns, and the files that have them, for each different header.

    Files are listed without being read. Small ones, however many, are read by one job that keeps their first lines; of each
    larger one, a limit of its own stops the reader after its first line. Spark keeps the list of a table's files in the
    driver anyway. A byte order mark is no part of the line.
    """
    listed = spark.read.format("binaryFile").load(path)
    by_line: dict[str, list[str]] = {}
    small = listed.filter((F.col("length") > 0) & (F.col("length") <= SMALL_FILE))
    begin = F.regexp_extract(F.col("content").cast("string"), "^[\ufeff\r\n]*([^\r\n]*)", 1).alias("line")
    for row in small.select("path", begin).filter("line <> ''").toLocalIterator():
        by_line.setdefault(row["line"], []).append(row["path"])
    files = [row["path"] for row in listed.filter(F.col("length") > SMALL_FILE).select("path").toLocalIterator()]
    for at in range(0, len(files), FILES_AT_ONCE):
        lines = [_first_line(spark, file) for file in files[at : at + FILES_AT_ONCE]]
        for row in reduce(DataFrame.unionAll, lines).collect():
            by_line.setdefault(row["line"], []).append(row["file"])
    return [(spark.read.options(**options).csv(min(found)).columns, sorted(found)) for _, found in sorted(by_line.items())]


def _first_line(spark: SparkSession, file: str) -> DataFrame:
    """A text file's first line that isn't empty; reading stops there."""
    line = F.ltrim(F.col("value"), F.lit("\ufeff")).alias("line")
    return spark.read.text(file, pathGlobFilter="*").select(F.lit(file).alias("file"), line).filter("line <> ''").limit(1)


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SUBSCRIBERS,
    multi_line: bool = False,
    with_position: bool = False,
    escaped: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """CSV files with a header, by path or glob: the rows that fit ``schema``, and the others as text with a reason.

    Columns are found by name in each file's own header, so files may have different ones; a column that only some
    have is null in the rows of others, one that no file has is absent, and those outside ``schema`` are ignored. A
    leading byte order mark is no part of the first name. A path without files is an error; files without a header have no
    rows. A line with too few or too many values, or with a value that isn't of its column's type, is a reject:
    ``file``, ``text`` (the line, or its cells as JSON), ``reason``.

    Texts with line breaks need ``multi_line``, which reads each file in one task, or an export with ``escaped`` breaks.
    ``with_position`` adds the ``POSITION`` columns.
    """
    checked = _checked_csv(spark, path, schema, multi_line, escaped)
    return _fitting(checked, with_position), _rejects(checked)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = SUBSCRIBERS,
    multi_line: bool = False,
    with_position: bool = False,
    escaped: bool = False,
) -> DataFrame:
    """The rows of ``read_csv_checked``, where there are no others: a line that doesn't fit fails the job that reads it."""
    return _fitting(_or_fail(_checked_csv(spark, path, schema, multi_line, escaped)), with_position)


def _checked_csv(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, escaped: bool
) -> DataFrame:
    """All lines: typed columns, ``POSITION``, ``_text`` and ``_reason`` (empty if the line fits)."""
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    parts = []
    for present, files in _headers(spark, path, **options):
        text_types = [T.StructField(name, T.StringType()) for name in [*present, BROKEN]]
        reader = spark.read.options(**options, columnNameOfCorruptRecord=BROKEN, columnPruning=False)
        lines = reader.schema(T.StructType(text_types)).csv(files)
        known = [f for f in schema if f.name in present]
        cells = {f.name: F.col(f"`{f.name}`") for f in known}
        if escaped:
            cells = {name: unescape_breaks(cell) for name, cell in cells.items()}
        problems = [F.when(F.col(BROKEN).isNotNull(), F.lit("not as many values as the header has"))]
        for f in known:
            if not isinstance(f.dataType, T.StringType):
                bad = cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull()
                problems.append(F.when(bad, F.lit(f"{f.name}: not a {f.dataType.simpleString()}")))
        reason = F.concat_ws("; ", *problems)
        position = [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ]
        typed = [cells[f.name].try_cast(f.dataType).alias(f.name) for f in known]
        as_json = F.to_json(F.struct(*[F.col(f"`{name}`") for name in present]))
        checked = lines.select(
            *typed, *position, F.coalesce(F.col(BROKEN), as_json).alias("_text"), reason.alias("_reason")
        )
        parts.append(checked)
    if not parts:
        names = [*schema.fields, *(T.StructField(c, T.StringType()) for c in (*POSITION, "_text", "_reason"))]
        return spark.createDataFrame([], T.StructType(names))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select(*[f.name for f in schema if f.name in whole.columns], *POSITION, "_text", "_reason")


def _fitting(checked: DataFrame, with_position: bool = False) -> DataFrame:
    """The rows without a reason against them."""
    dropped = ("_text", "_reason", *([] if with_position else POSITION))
    return checked.filter("_reason = ''").drop(*dropped)


def _rejects(checked: DataFrame) -> DataFrame:
    bad = checked.filter("_reason <> ''")
    return bad.select(*[F.col(f"_{name}").alias(name) for name in ("file", "text", "reason")])


def _or_fail(checked: DataFrame) -> DataFrame:
    """``checked``, failing at the first line that doesn't fit: none is lost without a word."""
    said = F.raise_error(F.concat_ws(": ", "_file", "_reason", "_text")).cast("boolean")
    return checked.filter(F.when(F.col("_reason") == "", F.lit(True)).otherwise(said))


def read_json_checked(
    spark: SparkSession, path: str, schema: T.StructType = COMMENTS, arrays: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The records that fit ``schema``, and the others (``file``, ``text``, ``reason``).

    One record per line, which can be split; or, with ``arrays``, files that each hold one JSON array, read whole by one
    task each: keep such files small and many.
    """
    checked = _checked_json(spark, path, schema, arrays)
    return _fitting(checked), _rejects(checked)


def _checked_json(spark: SparkSession, path: str, schema: T.StructType, arrays: bool) -> DataFrame:
    with_text = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    reader = spark.read.schema(with_text).option("multiLine", arrays).option("columnNameOfCorruptRecord", BROKEN)
    reason = F.when(F.col(BROKEN).isNull(), F.lit("")).otherwise("not a record of these types")
    position = [F.col("_metadata.file_path").alias("_file"), *[F.lit(None).cast("bigint").alias(c) for c in POSITION[1:]]]
    text = F.coalesce(F.col(BROKEN), F.to_json(F.struct(*schema.fieldNames()))).alias("_text")
    return reader.json(path).select(*schema.fieldNames(), *position, text, reason.alias("_reason"))


def read_json_comments(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """Files that each hold one JSON array of comments; a file that doesn't fit is an error."""
    return _fitting(_or_fail(_checked_json(spark, path, schema, True)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """Exports of ``writers.export_comments``: one comment per line, splittable; one that doesn't fit is an error."""
    return _fitting(_or_fail(_checked_json(spark, path, schema, False)))


def latest_path(spark: SparkSession, pattern: str) -> str:
    """The newest file that matches, by modification time. Lists files without reading them."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise FileNotFoundError(pattern)
    return newest["path"]


def read_latest_comments(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest export that matches: of directories (``.../comments_*``) or of JSON array files (``.../comments_*.json``)."""
    if pattern.endswith(".json"):
        return read_json_comments(spark, latest_path(spark, pattern))
    part = latest_path(spark, f"{pattern}/part-*")
    return read_json_lines(spark, part.rsplit("/", 1)[0])


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_snapshots(spark: SparkSession, path: str, date: datetime.date | str | None = None) -> DataFrame:
    """Reputation snapshots, newest first. A date reads its partition only."""
    snapshots = spark.read.schema(SNAPSHOTS).parquet(path)
    if date is not None:
        snapshots = snapshots.filter(F.col("snapshot_date") == F.lit(str(date)).cast("date"))
    return snapshots.orderBy(F.desc("snapshot_date"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
