"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words. Only DataFrame functions.

A paragraph is a line; a section is a run of paragraphs between blank lines; a paragraph's leaves are runs of words that end
after a word whose own hash says so, so that a word put in changes the leaf that it is in and no other. A node's hash
covers its children's, so equal roots mean equal texts. The fingerprint is the tree: the root, and for the whole text the
hashes of sections, paragraphs and leaves. Two trees are compared by their branches: sections that both have, as often as both
have them, count whole; of the others the paragraphs are compared like that, and of those that differ the leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keepwell.llm.common import SPACES, whole_text

#: A word and the white space behind it (before the first one, too); together they cover a line.
WORD = rf"[{SPACES}]*[^{SPACES}]+[{SPACES}]*|[{SPACES}]+"
#: A leaf ends after a word whose MD5 begins with a sign below this: one word of four.
ENDS = "4"
#: Hex signs of a leaf's or paragraph's hash, and of a section's, in a fingerprint.
LEAF, SECTION = 8, 16


def leaves(paragraph: Column) -> Column:
    """The hashes of a paragraph's leaves. Leaves are set apart by line breaks, which a paragraph has none of."""

    def with_end(word: Column) -> Column:
        return F.when(F.md5(word) < ENDS, F.concat(word, F.lit("\n"))).otherwise(word)

    words = F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0))
    runs = F.split(F.array_join(F.transform(words, with_end), ""), "\n", -1)
    return F.transform(F.filter(runs, lambda run: run != ""), lambda run: F.substring(F.md5(run), 1, LEAF))


def tree(text: Column) -> Column:
    """array<struct<hash, paragraphs: array<struct<hash, leaves>>>>: a section per element. The separators are part
    of the sections' places: joined by blank lines, their paragraphs joined by line breaks give the text again."""

    def paragraph(line: Column) -> Column:
        return F.struct(F.sha2(line, 256).alias("hash"), leaves(line).alias("leaves"))

    def section(paragraphs: Column) -> Column:
        own = F.sha2(F.concat_ws(",", F.transform(paragraphs, lambda p: p["hash"])), 256)
        return F.struct(own.alias("hash"), paragraphs.alias("paragraphs"))

    parts = F.transform(F.split(text, "\n\n", -1), lambda part: F.transform(F.split(part, "\n", -1), paragraph))
    return F.transform(parts, section)


def fingerprint(text: Column) -> Column:
    """The whole tree as a text: root ``:`` sections joined by ``;``. A section is its hash ``=`` paragraphs joined by ``,``; a
    paragraph its hash and its leaves' hashes. Texts are equal if, and but for a collision of SHA-256 only if, their
    fingerprints are."""

    def paragraph(p: Column) -> Column:
        return F.concat(F.substring(p["hash"], 1, LEAF), F.array_join(p["leaves"], ""))

    def section(s: Column) -> Column:
        return F.concat(F.substring(s["hash"], 1, SECTION), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))

    def whole(sections: Column) -> Column:
        root = F.sha2(F.concat_ws(",", F.transform(sections, lambda s: s["hash"])), 256)
        return F.concat(root, F.lit(":"), F.array_join(F.transform(sections, section), ";"))

    return F.get(F.transform(F.array(tree(text)), whole), F.lit(0))  # the tree is made once


def _sections(print_: Column) -> Column:
    return F.split(F.substring_index(print_, ":", -1), ";", -1)


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring_index(section, "=", -1), ",", -1)


def _each(values: Column) -> Column:
    """The values with the number of times that they came before, so that they are all different: in order, a value and its
    repeats are one match."""

    def spread(run: Column) -> Column:
        unit = F.substring_index(run, ";", 1)
        times = F.floor(F.length(run) / (F.length(unit) + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), times), lambda i: F.concat(unit, F.lit("#"), i.cast("string")))

    joined = F.concat(F.array_join(F.sort_array(values), ";"), F.lit(";"))
    runs = F.when(F.size(values) > 0, F.regexp_extract_all(joined, F.lit(r"([^;]*;)\1*"), F.lit(0)))
    return F.flatten(F.transform(F.coalesce(runs, F.array().cast("array<string>")), spread))


def _only(one: Column, other: Column) -> Column:
    """The values that the first array has more often than the second."""
    return F.transform(F.array_except(_each(one), _each(other)), lambda v: F.substring_index(v, "#", 1))


def _leaves_of(paragraphs: Column) -> Column:
    signs = F.transform(paragraphs, lambda p: F.substring(p, LEAF + 1, 2**31 - 1))
    return F.regexp_extract_all(F.array_join(signs, ""), F.lit(f".{{{LEAF}}}"), F.lit(0))


def _n_leaves(paragraphs: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.aggregate(paragraphs, zero, lambda n, p: n + F.floor((F.length(p) - LEAF) / LEAF).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the leaves that two fingerprinted texts have in common, each as often as both have it, by all leaves of
    both. Walks down the trees: only sections that differ are split into paragraphs, only such into leaves.

    Equal roots give 1; a text without leaves is unlike any with leaves.
    """

    def compare(x: Column) -> Column:
        one, two = (F.flatten(F.transform(x[name], _paragraphs)) for name in ("one", "two"))
        return F.struct(_only(one, two).alias("one"), _only(two, one).alias("two"), x["all"].alias("all"))

    def every(sections: Column) -> Column:
        return _n_leaves(F.flatten(F.transform(sections, _paragraphs)))

    def share(x: Column) -> Column:
        rest = F.size(F.array_intersect(_each(_leaves_of(x["one"])), _each(_leaves_of(x["two"]))))
        common = x["all"] - _n_leaves(x["one"]) - _n_leaves(x["two"]) + 2 * rest
        return F.coalesce(F.try_divide(common.cast("double"), x["all"].cast("double")), F.lit(0.0))

    one, two = _sections(a), _sections(b)
    differ = F.struct(_only(one, two).alias("one"), _only(two, one).alias("two"), (every(one) + every(two)).alias("all"))
    walked = F.get(F.transform(F.transform(F.array(differ), compare), share), F.lit(0))
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.lit(1.0)).otherwise(walked)


def first_edit(a: Column, b: Column) -> Column:
    """Where two fingerprinted texts begin to differ: struct<section, paragraph>, both from 0; -1 if they don't. The
    section is found by the sections' hashes, and only in it the paragraph by theirs."""

    def first(one: Column, two: Column, signs: int) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.size(one), F.size(two)) - 1)

        def differs(i: Column) -> Column:
            return ~F.substring(F.get(one, i), 1, signs).eqNullSafe(F.substring(F.get(two, i), 1, signs))

        return F.coalesce(F.get(F.filter(numbers, differs), F.lit(0)), F.lit(-1))

    def place(x: Column) -> Column:
        at = x["at"]
        one, two = (F.coalesce(_paragraphs(F.get(x[name], at)), F.array().cast("array<string>")) for name in ("one", "two"))
        inner = F.when((at >= 0) & (F.size(one) + F.size(two) > 0), first(one, two, LEAF)).otherwise(-1)
        return F.struct(at.cast("long").alias("section"), inner.cast("long").alias("paragraph"))

    one, two = _sections(a), _sections(b)
    found = F.struct(one.alias("one"), two.alias("two"), first(one, two, SECTION).alias("at"))
    return F.get(F.transform(F.array(found), place), F.lit(0))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Where two trees differ: array<struct<section, paragraph>>, both from 0, of the branches whose hashes differ or
    that only one tree has. Sections with equal hashes aren't walked."""

    def lines(sections: Column, i: Column) -> Column:
        return F.coalesce(F.get(sections, i)["paragraphs"], F.array())

    def hash_at(sections: Column, i: Column) -> Column:
        return F.get(sections, i)["hash"]

    def walk(i: Column) -> Column:
        one, two = lines(a, i), lines(b, i)
        numbers = F.sequence(F.lit(0), F.greatest(F.size(one), F.size(two), F.lit(1)) - 1)
        differ = F.filter(numbers, lambda j: ~F.get(one, j)["hash"].eqNullSafe(F.get(two, j)["hash"]))
        return F.transform(differ, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    numbers = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    differing = F.filter(numbers, lambda i: ~hash_at(a, i).eqNullSafe(hash_at(b, i)))
    return F.flatten(F.transform(differing, walk))


def with_next(docs: DataFrame, columns: dict[str, Column], per_partition: int = 8) -> DataFrame:
    """``doc_id``, the ``columns``, and ``next_<column>`` for each: those of the next document in descending ``doc_id``.

    The one after the last is the first; a single document is its own next. Documents without an id come last; rows
    with one id are ordered by a hash of their columns.

    The order is cut into ranges of ids, ``per_partition`` for each shuffle partition, at quantiles of the ids. A range
    ends at an id that exists, so the rows with that id are the first of their range, and are dealt to the range before
    it too. So texts move once, and no task gets more than a few ranges; only rows with one id stay together.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx(key, shares, 20 * n).alias("cuts"), F.max(key).alias("last")).first()
    ends = sorted({*(found["cuts"] or []), *([] if found["last"] is None else [found["last"]])})
    number = _below(ends, F.col("key"))
    own = F.struct(number.alias("range"), F.lit(False).alias("wraps"), F.lit(False).alias("guest"))
    before = F.struct((F.col("range") + 1).alias("range"), F.lit(False).alias("wraps"), F.lit(True).alias("guest"))
    wraps = F.struct(F.lit(0).alias("range"), F.lit(True).alias("wraps"), F.lit(True).alias("guest"))
    at_end = _numbers(ends)
    rows = docs.select("doc_id", key.alias("key"), *[c.alias(name) for name, c in columns.items()])
    rows = rows.withColumn("own", own).withColumn("range", F.col("own.range"))
    rows = rows.withColumn(
        "places",
        F.when(F.col("key") != F.get(at_end, F.col("range")), F.array("own"))
        .when(F.col("range") == len(ends) - 1, F.array(F.col("own"), wraps))
        .otherwise(F.array(F.col("own"), before)),
    )
    dealt = rows.drop("own", "range").withColumn("place", F.explode("places")).drop("places")
    order = Window.partitionBy("place.range").orderBy("place.wraps", F.desc("key"), F.xxhash64(*columns))
    following = [F.lead(name).over(order).alias(f"next_{name}") for name in columns]
    return dealt.select("doc_id", *columns, "place", *following).filter("not place.guest").drop("place")


def _numbers(values: list[int]) -> Column:
    """A constant array, as one folded literal."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _below(values: list[int], key: Column, step: int = 256) -> Column:
    """How many of the rising ``values`` are below ``key``: first among every ``step``-th, then between two of them."""
    some = F.size(F.filter(_numbers(values[::step]), lambda v: v < key))
    near = F.size(F.filter(F.slice(_numbers(values), F.greatest(some - 1, F.lit(0)) * step + 1, step), lambda v: v < key))
    return F.when(some > 0, (some - 1) * step + near).otherwise(0)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each document and an edit of it, fingerprinted: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``edit_section``, ``edit_paragraph`` (where the edit begins).

    The edit replaces the last third of the code points (rounded down) by as many first ones of the next document, or
    all if it has fewer. Null texts count as empty: their edit is empty too, and they are like empty texts only.
    Texts of any length are fingerprinted whole. Repeated rows each give a row; no documents give none; other columns are
    ignored.
    """
    text = whole_text()
    rows = with_next(docs, {"text": text, "fingerprint": fingerprint(text)})
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), third)))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    rows = rows.withColumn("edit", first_edit(F.col("fingerprint"), F.col("edited_fingerprint")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("edit.section").alias("edit_section"),
        F.col("edit.paragraph").alias("edit_paragraph"),
    )
