"""Links of pages: extraction, canonical form, one per post, a number per page, post dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from keepwell.functions import urls
from keepwell.operators.dedup import keep_first, top_per_key
from keepwell.session import materialize


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per ``href``: the page's other columns, ``position`` from 0, ``url``."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), F.lit(1))
    others = [c for c in pages.columns if c != html and c != "url"]
    return pages.select(*others, F.posexplode(hrefs).alias("position", "url"))


def post_links(links: DataFrame) -> DataFrame:
    """Links to posts only, with their ``canonical`` form and ``kind``."""
    url = F.col("url")
    marked = links.withColumns({"canonical": urls.canonical_url(url), "kind": urls.link_kind(url)})
    return marked.filter(F.col("kind").isNotNull())


def dedup_urls(links: DataFrame, sequence: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """The first link of every canonical URL, with the URL as it stood on the page."""
    return keep_first(links, [*scope, "canonical"], sequence)


def links_capped(links: DataFrame, page: Sequence[str], sequence: Sequence[str], max_posts: int) -> DataFrame:
    """The first ``max_posts`` links of every page."""
    return top_per_key(links, page, [F.col(c).asc() for c in sequence], max_posts)


def with_date_labels(links: DataFrame, longest: int | None = None) -> DataFrame:
    """``post_date`` from (aria_label, title, text, parent_text)."""
    parts = (F.col(c) for c in ("aria_label", "title", "text", "parent_text"))
    label = urls.post_date_label(*parts, longest)
    return links.withColumn("post_date", label)


def attach_post_date(comments: DataFrame, links: DataFrame) -> DataFrame:
    """Every comment with the date label of its post; ``links`` has one row per ``url``.

    The labels are stored first. Spark then knows their size and broadcasts
    them where they are few; otherwise both sides of the join are plain
    shuffles, so that adaptive execution can split a post with very many comments.
    """
    dates = links.select(F.col("url").alias("post_url"), F.col("post_date").alias("associated_post_date"))
    return comments.join(materialize(dates, "post-dates"), "post_url", "left")
