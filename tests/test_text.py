"""Text expressions against plain Python on awkward strings."""

import hashlib
import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from keepwell.functions import text as tx
from keepwell.functions import urls
from keepwell.operators import comments as cm

AWKWARD = [
    "", " ", " ", "a", "ab ", "　x y ", "x\x1fy", "three  blanks \n\t here", "No phrase",
    "See translation", "good See translation text", "Edited\nhello Edited ", "Hide See translation translation",
    "See more See more", "عرض  جديد See translation", "٣d", "See  translation", "Editedness", "​zero",
]


def collect(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", expression.alias("x"))
    return [r.x for r in sorted(rows.collect())]


def clean(text):
    for phrase in ("See translation", "Hide translation", "See more", "Edited"):
        text = re.sub(rf"\s*{phrase}\s*", " ", text)
    return " ".join(text.split())


def test_strip_squeeze_clean(spark):
    assert collect(spark, AWKWARD, tx.strip(F.col("t"))) == [t.strip() for t in AWKWARD]
    assert collect(spark, AWKWARD, tx.squeeze(F.col("t"))) == [" ".join(t.split()) for t in AWKWARD]
    assert collect(spark, AWKWARD, tx.clean_comment(F.col("t"))) == [clean(t) for t in AWKWARD]


WORDS = st.sampled_from(["See translation", "Edited", "See more", "Hide translation", "a", "٣", " ", "\n", " ", "\x1c", "é"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=12).map("".join), min_size=200, max_size=300))
def test_clean_random(spark, texts):
    assert collect(spark, texts, tx.clean_comment(F.col("t"))) == [clean(t) for t in texts]


def test_clean_all_short_sequences(spark):
    """Also where the removal of one phrase makes another."""
    tokens = ["See", "translation", "Hide", "more", "Edited", " ", "See translation"]
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product(tokens, repeat=n)]
    joined = [" ".join(t) for n in range(1, 6) for t in itertools.product(tokens[:5] + tokens[6:], repeat=n)]
    for group in (texts, joined):
        assert collect(spark, group, tx.clean_comment(F.col("t"))) == [clean(t) for t in group]


def test_every_white_space_is_known(spark):
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace()]
    assert collect(spark, [f"a{s}{s}b" for s in spaces], tx.squeeze(F.col("t"))) == ["a b"] * len(spaces)
    assert collect(spark, spaces, tx.is_blank(F.col("t"))) == [True] * len(spaces)


def is_author(name):
    name = name.strip()
    return (
        len(name) >= 3
        and name not in tx.BLOCKED_AUTHORS
        and not re.match(r"^\d+[dhwmy]$", name)
        and not re.match(r"^\d+$", name)
        and "facebook.com" not in name.lower()
        and "privacy" not in name.lower()
        and "/" not in name
    )


def test_authors(spark):
    names = [
        "Ali", "Al", " Al ", "Like", " Like\n", "like", "12h", "123", "٣٤d", "٣٤٥", "12hh", "www.Facebook.com", "PRIVACY x",
        "a/b", "Meta AI", "أمينة", "Feed", "Feeds", "5d ago", "100y", "Log Out", "Logout",
    ]
    frame = spark.createDataFrame([(n,) for n in names], "username string")
    kept = [r.username for r in cm.filter_authors(frame).collect()]
    assert kept == [n.strip() for n in names if is_author(n)]


def body(author, containers):
    """Line by line, as a person would read the boxes."""
    for box in containers:
        box = box.strip()
        if author not in box or len(box) <= len(author) + 10:
            continue
        found, kept = False, []
        for line in (part.strip() for part in box.split("\n")):
            if not line:
                continue
            if author in line:
                found = True
            elif found and line not in tx.UI_LINES:
                age = re.match(r"^\d+[dhwmy]$", line) or re.match(r"^\d+$", line)
                replies = "replied" in line.lower() or "replies" in line.lower()
                offer = "See translation" in line and len(line) < 20
                if not (age or replies or offer):
                    kept.append(line)
        if kept:
            return " ".join(kept)
    return None


BOXES = [
    ("Ali", ["Ali", "Ali\n3d", "header\nAli\n3d\ngood service\n \nLike\nReply", "outer\nAli\nother text"]),
    ("Ali", ["Ali\nAli replied\n4 Replies\nthanks a lot\nAli again\nsee you"]),
    ("Ali", ["text before Ali\nSee translation\nSee translation of all this\n٣d\n·\nFollow"]),
    ("Ali", ["no name in here at all", "Ali\nshort"]),
    ("Ali", ["Ali\n12345678901"]),
    ("Ali", ["Ali\n1234567 x", "never read"]),
    ("أمينة", ["أمينة\nالخدمة غالية بزاف\nأعجبني\nرد"]),
    ("Ali", ["x"] * 60 + ["Ali\nfar out but read"]),
    ("Ali", ["x"] * 5 + ["  Ali\n just near enough  "]),
    ("Ali", []),
]


def test_bodies(spark):
    rows = [(i, a, c) for i, (a, c) in enumerate(BOXES)]
    frame = spark.createDataFrame(rows, "i int, username string, containers array<string>")
    got = {r.i: r.text for r in cm.extract_bodies(frame).collect()}
    assert got == {i: body(a, c) for i, (a, c) in enumerate(BOXES)}
    near = {r.i: r.text for r in cm.extract_bodies(frame, boxes=6).collect()}
    assert near == {i: body(a, c[:6]) for i, (a, c) in enumerate(BOXES)}


LINES = st.sampled_from(["Ali", "Ali says", "Like", "3d", "12", "2 replies", "hello there", "See translation", "", " ", "Follow", "ok"])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(LINES, max_size=7).map("\n".join), max_size=8), min_size=100, max_size=150))
def test_bodies_random(spark, boxes):
    rows = [(i, "Ali", c) for i, c in enumerate(boxes)]
    frame = spark.createDataFrame(rows, "i int, username string, containers array<string>")
    got = {r.i: r.text for r in cm.extract_bodies(frame).collect()}
    assert got == {i: body("Ali", c) for i, c in enumerate(boxes)}


def test_extract_comments(spark):
    rows = [
        (1, "p1", "Ali", ["Ali\n3d\nSee more good  service"]),
        (2, "p1", "Ali", ["Ali\n4d\ngood service"]),
        (3, "p2", "Ali", ["Ali\n4d\ngood service"]),
        (4, "p1", "Like", ["Like\nthis is no comment"]),
        (5, "p1", "Sara", ["Sara\nEdited and See more"]),
        (6, "p1", "Sara", ["Sara\n" + "x" * 50 + "1", ""]),
        (7, "p1", "Sara", ["Sara\n" + "x" * 50 + "2", ""]),
    ]
    boxes = spark.createDataFrame(rows, "seq int, post_url string, username string, containers array<string>")
    got = {r.seq: r for r in cm.extract_comments(boxes, ["seq"]).collect()}
    assert sorted(got) == [1, 3, 5, 6, 7]
    texts = spark.createDataFrame([(1, "p", "a", "x" * 50 + "1"), (2, "p", "a", "x" * 50 + "2")], "seq int, post_url string, customer_id string, text string")
    assert [r.seq for r in cm.dedup_comments(texts, ["seq"], prefix=50).collect()] == [1]
    assert got[1].text == "good service"
    assert got[1].customer_id == hashlib.md5(b"Ali").hexdigest()[:12]


def test_pseudonyms_of_unicode(spark):
    names = ["Ali", "ام افنان", "Zoë"]
    want = [hashlib.md5(n.encode()).hexdigest()[:12] for n in names]
    assert collect(spark, names, tx.pseudonym(F.col("t"))) == want


def test_clean_id(spark):
    assert collect(spark, [" 'A\"1' ", "\tB2\n", "'"], tx.clean_id(F.col("t"))) == ["A1", "B2", ""]


def test_drop_blank(spark):
    frame = spark.createDataFrame([(1, " a "), (2, " "), (3, None), (4, "")], "i int, text string")
    assert [tuple(r) for r in cm.drop_blank(frame).collect()] == [(1, "a")]


def label(aria, title, text, parent, longest=None):
    shown = aria or title
    if not shown or "playback" in shown.lower():
        shown = text
    shown = shown.strip() if shown else ""
    if not shown or longest and len(shown) > longest or "video" in shown.lower():
        if parent is None:
            shown = "Recent Post"
        elif parent:
            shown = parent.strip()
    return shown or "Recent Post"


def test_post_date_labels(spark):
    parts = [None, "", " ", "2 May", "Playback speed", "a VIDEO", "x" * 41]
    rows = [(a, t, x, p) for a in parts for t in parts for x in parts for p in parts]
    frame = spark.createDataFrame(rows, "a string, t string, x string, p string")
    for longest in (None, 40):
        got = frame.select("*", urls.post_date_label(*[F.col(c) for c in "atxp"], longest).alias("got")).collect()
        assert [r.got for r in got] == [label(*row, longest) for row in rows]


@pytest.mark.parametrize(
    "url, canonical, kind",
    [
        ("https://h/a/posts/1?x=1?y", "https://h/a/posts/1", "post"),
        ("https://h/reel/7", "https://h/reel/7", "reel"),
        ("https://h/permalink.php?id=1", "https://h/permalink.php", "permalink"),
        ("https://h/about?next=/posts/", "https://h/about", "post"),
        ("https://h/about", "https://h/about", None),
    ],
)
def test_urls(spark, url, canonical, kind):
    row = spark.createDataFrame([(url,)], "u string").select(
        urls.canonical_url(F.col("u")).alias("c"), urls.link_kind(F.col("u")).alias("k")
    )
    assert tuple(row.first()) == (canonical, kind)
