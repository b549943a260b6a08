"""From comment boxes to a clean comment table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import text as tx
from keepwell.operators.dedup import keep_first
def filter_authors(df: DataFrame, blocked: Sequence[str] = tx.BLOCKED_AUTHORS) -> DataFrame:
    """Rows whose ``username`` can be a person."""
    return df.withColumn("username", tx.strip(F.col("username"))).filter(tx.is_author(F.col("username"), blocked))


def extract_bodies(df: DataFrame, boxes: int | None = None) -> DataFrame:
    """``text`` from the nested ``containers`` (the innermost ``boxes`` of them, or all) around each ``username``; null
    where there is none."""
    return df.withColumn("text", tx.comment_body(F.col("username"), F.col("containers"), boxes)).drop("containers")


def clean_comments(df: DataFrame, least: int = 3) -> DataFrame:
    """Drop texts under ``least`` characters, clean the others.

    The length counts before cleaning, so a cleaned text can be empty;
    ``drop_blank`` removes those.
    """
    long_enough = F.length(tx.strip(F.col("text"))) >= least
    return df.filter(long_enough).withColumn("text", tx.clean_comment(F.col("text")))


def drop_blank(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows with a text, stripped.

    Written as an explode, which evaluates the text once; Spark would evaluate
    a filter on a computed text below the projection and the text again in it.
    """
    return df.withColumn(column, F.explode(F.filter(F.array(tx.strip(F.col(column))), lambda text: text != "")))


def pseudonymize(df: DataFrame) -> DataFrame:
    return df.withColumn("customer_id", tx.pseudonym(F.col("username")))


def dedup_comments(df: DataFrame, sequence: Sequence[str], prefix: int | None = None) -> DataFrame:
    """One comment per post, author and text: the first by ``sequence``.

    With ``prefix``, comments with that many equal first characters count as one, which drops different texts.
    """
    text = F.col("text") if prefix is None else F.substring(F.col("text"), 1, prefix)
    return keep_first(df, ["post_url", "customer_id", text], sequence)


def extract_comments(boxes: DataFrame, sequence: Sequence[str]) -> DataFrame:
    """Comments from (post_url, username, containers): author rules, text, ids, de-duplication."""
    texts = clean_comments(extract_bodies(filter_authors(boxes)))
    return dedup_comments(pseudonymize(texts), sequence)


def extract_summary(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """How many discovered posts gave comments, how many gave none, how many comments there are.

    Comments are counted per post before anything is joined.
    """
    per_post = comments.groupBy("post_url").agg(F.count("*").alias("n"))
    joined = posts.select("post_url").distinct().join(per_post, "post_url", "left")
    return joined.agg(
        F.count_if(F.col("n").isNotNull()).alias("posts_processed"),
        F.count_if(F.col("n").isNull()).alias("posts_skipped"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("comments"),
    )
