"""Text expressions: Unicode-aware trimming, comment clean-up, author rules, pseudonyms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Every character that counts as white space in Unicode or as an ASCII separator.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SPACE = r"[\s\x1c-\x1f]"  # the same set in a pattern that starts with (?U)

# Interface phrases that get glued to comment texts.
UI_PHRASES = ("See translation", "Hide translation", "See more", "Edited")

# Lines of a comment box that are buttons, not text.
UI_LINES = ("Like", "Reply", "أعجبني", "رد", "·", "Follow")

# Link texts that are interface elements, not people.
BLOCKED_AUTHORS = (
    "Follow", "Like", "Reply", "Share", "Comment", "Orange", "Meta AI",
    "Groups", "Find friends", "Home", "Create", "Menu", "Notifications",
    "Saved", "Memories", "Privacy", "Terms", "Advertising", "Ad choices",
    "Cookies", "Sweet Pie", "Friends", "Reels", "Feeds", "Events",
    "Ads Manager", "Play games", "For you", "Profile", "Watch",
    "Marketplace", "Messenger", "Search", "Pages", "Settings",
    "Help", "Log Out", "Create Post", "Live", "Gaming", "Fundraisers",
    "Feed",
)

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"(?U){_SPACE}+", " "))


def escape_breaks(text: Column) -> Column:
    """Line breaks as backslash and letter, backslashes doubled."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_breaks(text: Column) -> Column:
    """What ``escape_breaks`` was given. Between doubled backslashes, a single one can only belong to a break."""

    def part(piece: Column) -> Column:
        return F.replace(F.replace(piece, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _has_phrase(text: Column) -> Column:
    found = F.lit(False)
    for phrase in UI_PHRASES:
        found = found | F.contains(text, F.lit(phrase))
    return found


def _without_phrases(text: Column) -> Column:
    """One phrase after the other, each with the white space around it."""
    for phrase in UI_PHRASES:
        text = F.regexp_replace(text, f"(?U){_SPACE}*{phrase}{_SPACE}*", " ")
    return text


def clean_comment(text: Column) -> Column:
    """Remove interface phrases, then squeeze white space.

    Plain replacement is much cheaper than patterns and gives the same text
    once it is squeezed, unless the removal of one phrase puts the words of a
    later one side by side. Such a text still shows a phrase; only then the patterns run.
    """
    plain = text
    for phrase in UI_PHRASES:
        plain = F.replace(plain, F.lit(phrase), F.lit(" "))
    return let(squeeze(plain), lambda short: F.when(_has_phrase(short), squeeze(_without_phrases(text))).otherwise(short))


def clean_id(value: Column) -> Column:
    """An identifier as typed by a user: no outer white space, no quote characters."""
    return F.translate(strip(value.cast("string")), "\"'", "")


def is_age_or_number(text: Column) -> Column:
    """A relative age such as ``3d`` or ``12w``, or only digits, of any script."""
    return text.rlike(r"(?U)^\d+[dhwmy]?$")


def is_author(name: Column, blocked: Sequence[str] = BLOCKED_AUTHORS, least: int = 3) -> Column:
    """Whether a link text, of ``least`` characters or more, can be a person's name. Expects it stripped."""
    folded = F.lower(name)
    return (
        (F.length(name) >= least)
        & ~name.isin(*blocked)
        & ~is_age_or_number(name)
        & ~F.contains(folded, F.lit("facebook.com"))
        & ~F.contains(folded, F.lit("privacy"))
        & ~F.contains(name, F.lit("/"))
    )


def pseudonym(name: Column) -> Column:
    """A stable id that doesn't show the name."""
    return F.substring(F.md5(name), 1, 12)


def _is_comment_line(line: Column) -> Column:
    folded = F.lower(line)
    return (
        ~line.isin(*UI_LINES)
        & ~is_age_or_number(line)
        & ~F.contains(folded, F.lit("replied"))
        & ~F.contains(folded, F.lit("replies"))
        & ~(F.contains(line, F.lit("See translation")) & (F.length(line) < 20))
    )


def _lines_after_author(lines: Column, author: Column) -> Column:
    def after(first: Column, lines: Column) -> Column:
        return F.filter(
            lines,
            lambda line, i: (first > 0) & (i >= first) & ~F.contains(line, author) & _is_comment_line(line),
        )

    def search(lines: Column) -> Column:
        mentions = F.transform(lines, lambda line: F.contains(line, author))
        return let(F.array_position(mentions, True), lambda first: after(first, lines))

    return let(lines, search)


def _container_text(container: Column, author: Column, more: int) -> Column:
    """The comment in one box, null without one."""
    big_enough = F.contains(container, author) & (F.length(container) > F.length(author) + more)
    lines = F.filter(F.transform(F.split(container, "\n"), strip), lambda line: line != "")
    text = F.array_join(_lines_after_author(lines, author), " ")
    return F.when(big_enough, F.nullif(text, F.lit("")))


def comment_body(author: Column, containers: Column, boxes: int | None = None, more: int = 10) -> Column:
    """The comment inside the boxes around an author's name, innermost box first: all, or the first ``boxes``.

    A box counts if it names the author and has more than ``more`` other characters;
    its lines after the first one naming the author, without interface lines,
    are the comment. Null where no box gives one. Boxes behind the first hit aren't looked at.
    """
    return F.aggregate(
        containers if boxes is None else F.slice(containers, 1, boxes),
        F.lit(None).cast("string"),
        lambda found, box: F.when(found.isNotNull(), found).otherwise(
            let(strip(box), lambda inner: _container_text(inner, author, more))
        ),
    )
