"""Link expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keepwell.functions.text import strip

# The path parts that mark a post, and the label of a post without a date.
POST_PATHS = {"/posts/": "post", "/reel/": "reel", "/permalink.php": "permalink"}
UNDATED = "Recent Post"


def canonical_url(url: Column) -> Column:
    """Without the query string."""
    return F.substring_index(url, "?", 1)


def link_kind(url: Column) -> Column:
    """post, reel or permalink; null for any other link."""
    return F.coalesce(*[F.when(F.contains(url, F.lit(path)), F.lit(kind)) for path, kind in POST_PATHS.items()])


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def post_date_label(
    aria_label: Column, title: Column, text: Column, parent_text: Column, longest: int | None = None
) -> Column:
    """The date text shown for a post.

    An attribute wins over the link text; one that is missing, about a video, or over ``longest`` characters
    gives way to the text around the link (null: no such element).
    """
    attribute = F.when(_filled(aria_label), aria_label).otherwise(title)
    unusable = ~_filled(attribute) | F.contains(F.lower(attribute), F.lit("playback"))
    label = strip(F.coalesce(F.when(unusable, text).otherwise(attribute), F.lit("")))
    doubtful = (label == "") | F.contains(F.lower(label), F.lit("video"))
    if longest is not None:
        doubtful = doubtful | (F.length(label) > longest)
    around = (
        F.when(parent_text.isNull(), F.lit(UNDATED)).when(parent_text != "", strip(parent_text)).otherwise(label)
    )
    chosen = F.when(doubtful, around).otherwise(label)
    return F.when(chosen == "", F.lit(UNDATED)).otherwise(chosen)
