"""Main text of web pages by tree scoring.

Each block of text earns points for its length and commas, less its share of link text. Its container gets them and
passes part of them on to its own container, all of them but a trace where it is the only one there with points. The
container with most points is the article, or the ``article`` or ``main`` around it; its siblings are kept with it unless
they are mostly links. Elements whose class or id tells that they aren't the article are left out, but not those around the
page's main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.common import small_batches

#: Element names by what HTML says of them, and words in class or id that tell what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd td th figcaption summary caption".split())
DROPPED = frozenset(
    "nav header footer aside form button select option datalist fieldset dialog menu audio video canvas map head".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments "
    "commentlist reply replies respond disqus sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent gdpr notice notices notification banner popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar skip outbrain taboola".split()
)
#: What an open element of the first name is closed by: a start of one of the others.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option"},
}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}

#: Parts of its points that a container passes on: alone, and beside others with points.
ALONE, BESIDE = 0.999, 0.55
#: Times the points of elements that say they are the article; a sibling's least share of the best one's points, or else its
#: largest share of text in links; the share of all points that is the page's main text whatever its class.
NAMED, SHARE, LINKED, MOST = 1.5, 0.2, 0.5, 0.8
#: Words in class or id of an ``article`` that is a reader's.
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: A heading of readers' comments, and what short texts at an article's edges are notices by.
READERS_HEADING = re.compile(
    r"(?:\d+\s+)?(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I
)
NOTICE = re.compile(
    r"\bcookies?\b|\bprivacy\b|all rights reserved|©|\bcopyright\b|\bterms of (?:use|service)\b|datenschutz|alle rechte vorbehalten|"
    r"tous droits réservés|todos los derechos reservados|\bnewsletter\b", re.I
)
#: Characters that a notice has at most.
BRIEF = 200
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in page order, in linear time.

    Comments, declarations and the insides of raw elements are left out. What is cut off at the page's end counts as
    far as it goes.
    """
    at, n, no_quote = 0, len(page), set()
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            yield "text", page[at:], ""
            return
        if tag > at:
            yield "text", page[at:tag], ""
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", tag + 1)
        name = NAME.match(page, tag + 1 + closing)
        if not name:
            if page.startswith(("!", "?", "/"), tag + 1):
                end = page.find(">", tag)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = tag + 1
            continue
        start, end = name.end(), page.find(">", name.end())
        if end < 0:
            return
        seen = start
        while True:  # a quoted value may hold the sign
            quotes = [(i, q) for q in "\"'" if q not in no_quote and (i := page.find(q, seen, end)) >= 0]
            if not quotes:
                break
            first, quote = min(quotes)
            close = page.find(quote, first + 1)
            if close < 0:
                no_quote.add(quote)
                continue
            seen = close + 1
            if close > end:
                after = page.find(">", close)
                if after < 0:
                    break
                end = after
        at, word = end + 1, name.group().lower()
        if closing:
            yield "end", word, ""
        elif word in RAW:
            found = RAW_END[word].search(page, at)
            stop = found.start() if found else n
            end = page.find(">", stop)
            at = n if end < 0 else end + 1
        else:
            yield "start", word, page[start:end]


def outside(name: str, attributes: str, own: bool = False) -> bool | set[str]:
    """Whether an element isn't part of an article, by its name or role, or because it is hidden; or the words in its class
    or id that hint at it. ``own``: it is the article's own header, or the source of a quotation, whatever its name."""
    hints: set[str] = set()
    if name in DROPPED and not own:
        return True
    if not attributes or name in ("html", "body"):
        return hints
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id"):
            hints.update(word.lower() for word in WORDS.findall(value) if word.lower() in HINTS)
    return hints


class Page:
    """A page's elements (number of the parent, name) and its blocks of text (element, text, characters in links)."""

    def __init__(self, page: str):
        self.parent, self.name, self.blocks, self.hints = [-1], [""], [], {}
        self.open, self.count, self.out = [0], {}, 0  # out: the number of the element that is left out, or 0
        self.run, self.links, self.in_link = [], 0, 0
        for kind, what, more in markup(page):
            if kind == "text":
                self._text(what)
            elif kind == "start":
                self._start(what, more)
            else:
                self._end(what)
        self._flush()

    def _text(self, text: str) -> None:
        if not self.out:
            text = html.unescape(text) if "&" in text else text
            self.run.append(text)
            if self.in_link:
                self.links += len(text.strip())

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                owner = next(i for i in reversed(self.open) if self.name[i] not in INLINE or i in self.hints)
                self.blocks.append((owner, text, min(self.links, len(text))))
            self.run = []
        self.links = 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "hr":
            self._text(" ")
        if name in VOID:
            return
        if name not in INLINE:
            self._flush()
            if self.count.get("p"):
                self._close("p")
            top = self.name[self.open[-1]]
            if name in CLOSED_BY.get(top, ()):
                self._close(top)
        self.parent.append(self.open[-1])
        self.name.append(name)
        self.open.append(len(self.name) - 1)
        self.count[name] = self.count.get(name, 0) + 1
        self.in_link += name == "a"
        own = name == "header" and self.count.get("article") or name == "footer" and self.count.get("blockquote")
        if not self.out and (found := outside(name, attributes, bool(own))):
            here = self.open.pop()
            self._flush()
            self.open.append(here)
            if found is True:
                self.out = here
            else:
                self.hints[here] = found

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        if self.count.get(name):
            self._close(name)

    def _close(self, name: str) -> None:
        while True:
            if self.open[-1] in self.hints:
                self._flush()
            last = self.open.pop()
            closed = self.name[last]
            self.count[closed] -= 1
            self.in_link -= closed == "a"
            if last == self.out:
                self._flush()
                self.out, self.run = 0, []
            if closed == name:
                return

    def _inside(self, amounts: dict[int, float]) -> list[float]:
        """What each element has of what blocks give their owners, with all that is inside it."""
        total = [0.0] * len(self.name)
        for i, amount in amounts.items():
            total[i] = amount
        for i in range(len(self.name) - 1, 0, -1):  # a parent's number is below its children's
            total[self.parent[i]] += total[i]
        return total

    def _unhinted(self) -> list[tuple[int, str, int]]:
        """The blocks that no hint leaves out. Hints don't hold for the largest ``article`` and ``main``, for what is around
        them, and for elements with most of the page's points."""
        if not self.hints:
            return self.blocks
        earned: dict[int, float] = {}
        for owner, text, links in self.blocks:
            earned[owner] = earned.get(owner, 0) + worth_of(text, links)
        total, void = self._inside(earned), set(self.hints)
        for kind in ("article", "main"):
            named = [i for i, name in enumerate(self.name) if name == kind and not READERS & self.hints.get(i, set())]
            at = max(named, key=total.__getitem__, default=0)
            while at > 0:
                void.discard(at)
                at = self.parent[at]
        void = {i for i in void if total[i] < MOST * total[0] or not total[i]}
        out = [False] * len(self.name)
        for i in range(1, len(self.name)):
            out[i] = i in void or out[self.parent[i]]
        kept = [not out[owner] for owner, _, _ in self.blocks]
        for i, (owner, text, _) in enumerate(self.blocks[:-1]):  # the heading of comments that are left out goes with them
            if self.name[owner] in HEADINGS and not kept[i + 1] and READERS_HEADING.fullmatch(text):
                kept[i] = False
        return [block for block, keep in zip(self.blocks, kept) if keep]

    def article(self) -> list[str]:
        """The blocks of the best container and of its siblings that are kept, in page order; without regard to hints, if
        they leave none; and if nothing earns points, all text of the largest article, or of the page."""
        some = self._unhinted()
        return self._best(some) or self._best(self.blocks) or self._visible(some or self.blocks)

    def _visible(self, blocks: list[tuple[int, str, int]]) -> list[str]:
        chars: dict[int, int] = {}
        for owner, text, _ in blocks:
            chars[owner] = chars.get(owner, 0) + len(text)
        total = self._inside(chars)
        named = [i for i, name in enumerate(self.name) if name in ("article", "main") and total[i]]
        largest = max(named, key=total.__getitem__, default=0)

        def inside(i: int) -> bool:
            while i > largest:
                i = self.parent[i]
            return i == largest

        return [text for owner, text, _ in blocks if inside(owner)]

    def _notices(self, blocks: list[tuple[int, str, int]], best: int, weight: list[float]) -> set[int]:
        """Brief notices without any mark of their own: beside the best container or in it, before the first or after the last
        element that counts there."""
        found: set[int] = set()
        for up in {self.parent[best], best} - {-1}:
            if up == best and self.name[best] in ("article", "main"):
                continue
            within = [i for i in range(1, len(self.name)) if self.parent[i] == up and i != best]
            texts: dict[int, list[str]] = {i: [] for i in within if self.name[i] not in PARAGRAPHS}
            for owner, text, _ in blocks if texts else ():
                while owner > 0 and self.parent[owner] != up:
                    owner = self.parent[owner]
                if owner in texts:
                    texts[owner].append(text)
            brief = {i for i, own in texts.items() if sum(map(len, own)) <= BRIEF and any(map(NOTICE.search, own))}
            least = 1 if up == best else SHARE * weight[best]
            counts = [i for i in within if weight[i] >= least and i not in brief] + [best] * (up != best)
            if counts:
                found |= {i for i in brief if i < min(counts) or i > max(counts)}
        return found

    def _best(self, blocks: list[tuple[int, str, int]]) -> list[str]:
        size = len(self.name)
        points, sources, own = [0.0] * size, [0] * size, [0.0] * size
        for owner, text, links in blocks:
            earned = worth_of(text, links)
            if earned > 0:
                own[owner] += earned
                holder = self.parent[owner] if self.name[owner] in PARAGRAPHS else owner
                points[holder] += earned
                sources[holder] += 1
        has = [n > 0 for n in sources]
        for i in range(size - 1, 0, -1):  # a parent's number is below its children's
            if has[i]:
                sources[self.parent[i]] += 1
                has[self.parent[i]] = True
        for i in range(size - 1, 0, -1):
            up = self.parent[i]
            points[up] += points[i] * (ALONE if sources[up] == 1 else BESIDE)
        worth = [p * (NAMED if name in ("article", "main") else 1) for p, name in zip(points, self.name)]
        best = max(range(size), key=worth.__getitem__)
        if worth[best] <= 0:
            return []
        around = best
        while around > 0 and self.name[around] not in ("article", "main"):
            around = self.parent[around]
        best = around if around > 0 else best
        chars, linked = {}, {}
        for owner, text, links in blocks:
            chars[owner], linked[owner] = chars.get(owner, 0) + len(text), linked.get(owner, 0) + links
        chars, linked = self._inside(chars), self._inside(linked)
        kept, notices = [False] * size, self._notices(blocks, best, [max(a, b) for a, b in zip(points, own)])
        for i in range(size):
            if i in notices:
                continue
            if i == best or i and kept[self.parent[i]]:
                kept[i] = True
            elif best and self.parent[i] == self.parent[best]:
                title = i < best and self.name[i] in ("h1", "h2") and own[i] > 0
                kept[i] = title or linked[i] <= LINKED * chars[i] or max(points[i], own[i]) >= SHARE * points[best]
        return [text for owner, text, _ in blocks if kept[owner]]


def worth_of(text: str, links: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))


def main_text(page: str | None) -> str:
    return "\n\n".join(Page(page).article()) if page else ""


def extract_main_text(pages: DataFrame, at_once: int = 64) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``: the article of each page's whole ``html``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and hidden elements are left
    out; the blocks of the rest are joined by empty lines, white space within a block is one space. Null or
    empty pages, and pages without text, give an empty text. Rows are independent and keep their order and repeats;
    other columns are left out. Nothing is shuffled, and a page's work grows with its length.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                some = batch.slice(at, at_once)
                texts = [main_text(page) for page in some.column(2).to_pylist()]
                columns = [some.column(0), some.column(1), pa.array(texts, pa.string())]
                sizes = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, sizes], ["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
