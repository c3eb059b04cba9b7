"""Main text of web pages by two passes over blocks.

A page is cut into blocks at block-level tags. Pass one adds up the evidence
on a block: stop-word density and length speak for text, link density against
it; what the mark-up says weighs in as well. Elements that are page furniture
(menu, header, footer, sidebar, notice, advert, form, comments) weigh against
their blocks; a mark that would take two thirds of a page of prose is not
believed, save for comments. ``article`` and ``main`` weigh for their blocks
and against the rest, unless there is more prose outside than text in them. Blocks
too short to tell stay open. Pass two gives an open block the label of its
nearest decided neighbours: theirs if they agree, else that of the nearer,
text on a tie; the borders of the article count as text, the borders of the
page as boilerplate.

Marks are whole words of class, id and role; a class such as has-sidebar
(a state) or post-header (a part of the article) is none. An element that is
never closed marks its first block only. Inline elements that are hidden or
adverts lose their text.

Defined cases: a null, empty or text-free page gives an empty string and 0
characters. Tags may be unclosed, mis-nested or cut off; text after the last
tag counts. Time is linear in the page, broken or not. Repeated rows are
extracted one by one; an empty table gives an empty result; other columns of
``pages`` are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the supported languages (fixed values).
STOP_WORDS = frozenset(
    (
        "the of and to in a is that it for was on are as with be by at this from or have an not but they which you his her "
        "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
        "le la les de des du et en un une que qui dans pour par sur est au aux avec ce il ne pas plus se son sa ou "
        "el los las y que del se por con para una su al lo como más pero sus o este sí porque esta entre no es"
    ).split()
)

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form button select option dialog menu svg canvas object audio video map head".split())
MAIN = frozenset(("article", "main"))
#: A start tag ends an open element of these, up to the list or table it is in.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())
#: Words in class, id or role that mark page furniture (fixed values).
ADVERT = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promotion".split())
COMMENT = frozenset(
    "comment comments commentlist respond reply replies responses reactions discussion discussions disqus feedback reviews guestbook "
    "kommentar kommentare commentaire commentaires comentario comentarios commenti komentarze".split()
)
MARK = (
    ADVERT
    | COMMENT
    | frozenset(
        "banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sidebar aside complementary widget "
        "related recommended footer header masthead contentinfo topbar share sharing social newsletter subscribe signup login search form skip copyright legal".split()
    )
)
#: Words that make a class name a state, or a part of the article (fixed values).
STATE = frozenset("has with no without is not hide show".split())
PART = frozenset("post article entry story content section".split())
BODY = frozenset("text body content copy paragraph".split())
#: Tags whose mark always holds (fixed values).
SURE = frozenset("nav footer aside select option dialog menu svg canvas object audio video map head".split())
SPLIT = re.compile(r"[_-]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"\w+")


class Element:
    """A marked element: whether its end tag came, whether its mark holds
    whatever else the page has, its blocks, its parent."""

    __slots__ = ("closed", "first", "last", "sure", "up")

    def __init__(self, sure: bool, first: int, up: Element | None):
        self.closed, self.sure, self.first, self.last, self.up = False, sure, first, -1, up


#: Text, characters in links, innermost marked element, and 1 in the article or
#: 2 in a heading of the first order outside of it.
Block = tuple[str, int, Element | None, int]


def marks(value: str) -> set[str]:
    """The furniture words among the names in a class, id or role."""
    found: set[str] = set()
    for name in value.split():
        words = SPLIT.split(HUMP.sub("-", name).lower())
        if STATE.intersection(words):
            continue
        own = MARK.intersection(words)
        if words[0] in PART:
            own -= MARK - COMMENT if words[-1] in BODY else {"header"}
        found |= own
    return found


def attributes(raw: str) -> tuple[set[str], bool]:
    """(furniture words, hidden) of the attributes of a tag."""
    found: set[str] = set()
    hidden = False
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            found |= marks(value)
        elif name == "hidden":
            hidden |= value.lower() not in ("false", "until-found")
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            style = value.lower().replace(" ", "")
            hidden |= "display:none" in style or "visibility:hidden" in style
    return found, hidden


class Reader:
    """Tags and texts of a page from left to right, each character once."""

    def __init__(self, page: str):
        self.page = page
        self.none_left: set[str] = set()  # characters that don't come again

    def find(self, what: str, at: int) -> int:
        if what in self.none_left:
            return -1
        p = self.page.find(what, at)
        if p < 0:
            self.none_left.add(what)
        return p

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``."""
        p = at
        while True:
            m = STOP.search(self.page, p) if ">" not in self.none_left or p == at else None
            if not m:
                return self.find(">", at)
            if m[0] == ">":
                return m.start()
            q = self.find(m[0], m.end())
            if q < 0:  # the quote stays open: the tag ends where it can
                return self.find(">", at)
            p = q + 1


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    open_tags: list[tuple[str, Element | None, bool]] = []  # tag, marked element, article
    places: dict[str, list[int]] = {}  # of the open elements of a tag
    lists: list[int] = []  # places of open lists and tables
    parts: list[str] = []
    linked: list[str] = []
    in_link, article = False, 0
    element: Element | None = None  # innermost marked one
    own: Element | None = None  # of the paragraph at hand
    skipped, depth = "", 0  # inline element whose text is left out
    read = Reader(page)

    def flush() -> None:
        nonlocal own, skipped
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            links = " ".join(html.unescape("".join(linked)).split())
            out.append((text, len(links), own or element, 1 if article else 2 if places.get("h1") else 0))
        parts.clear()
        linked.clear()
        own, skipped = None, ""

    def pop(explicit: bool) -> str:
        nonlocal article, element
        tag, e, a = open_tags.pop()
        places[tag].pop()
        if tag in LISTS:
            lists.pop()
        article -= a
        if e is not None:
            e.closed, e.last, element = explicit, len(out), e.up
        return tag

    at, end = 0, len(page)
    while at < end:
        p = page.find("<", at)
        stop = end if p < 0 else p
        m = NAME.match(page, p + 1) if p >= 0 else None
        if p >= 0 and not m and page[p + 1 : p + 2] not in ("!", "?"):
            stop = p + 1  # a bare "<"
        if stop > at and not skipped:
            parts.append(page[at:stop])
            if in_link:
                linked.append(page[at:stop])
        if p < 0:
            break
        if not m:
            if stop == p:
                long = page.startswith("<!--", p)
                q = read.find("-->" if long else ">", p + 2)
                at = end if q < 0 else q + (3 if long else 1)
            else:
                at = stop
            continue
        q = read.tag_end(m.end())
        if q < 0:  # no tag ends any more: the rest is text
            if not skipped:
                parts.append(page[p:])
            break
        raw, at = page[m.end() : q], q + 1
        tag, closing = m[1].lower(), page[p + 1] == "/"
        if tag in RAW and not closing:
            found = RAW_END[tag].search(page, at)
            q = read.find(">", found.end()) if found else -1
            at = q + 1 if q >= 0 else end
            continue
        if skipped and tag == skipped:
            depth += -1 if closing else 1
            if not depth:
                skipped = ""
            continue
        if tag in INLINE or tag == "br":
            if tag == "a" and not skipped:
                in_link = not closing
            if tag == "br":
                parts.append(" ")
            elif raw and not closing and not skipped and not raw.endswith("/"):
                found, hidden = attributes(raw)
                if hidden or found & ADVERT:
                    skipped, depth = tag, 1
            continue
        flush()
        in_link = False
        if closing:
            # A stray end tag closes nothing; others close what they contain.
            if places.get(tag):
                while pop(open_tags[-1][0] == tag) != tag:
                    pass
            continue
        if tag in VOID:
            continue
        for inner in ENDS.get(tag, ()):
            # An item ends the one before it in the same list.
            k = places[inner][-1] if places.get(inner) else -1
            if k > (lists[-1] if lists else -1):
                while len(open_tags) > k:
                    pop(True)
        found, hidden = attributes(raw) if raw else (set(), False)
        plain = tag in ("html", "body", *MAIN)
        f = tag in FURNITURE or (tag == "header" and not article) or (bool(found) and not plain) or hidden
        if f and article and tag != "header" and not hidden and found <= {"header"} and tag not in FURNITURE:
            f = False  # a heading group inside the article is part of it
        if tag == "p":  # ends at the next block, marked or not
            if f:
                own = Element(hidden or bool(found & COMMENT), len(out), element)
                own.closed, own.last = True, len(out) + 1
            continue
        if raw.rstrip().endswith("/"):
            continue
        a = tag in MAIN
        e = Element(hidden or tag in SURE or bool(found & COMMENT), len(out), element) if f else None
        places.setdefault(tag, []).append(len(open_tags))
        if tag in LISTS:
            lists.append(len(open_tags))
        open_tags.append((tag, e, a))
        article += a
        element = e or element
    flush()
    while open_tags:
        pop(False)
    return out


def densities(text: str) -> tuple[int, float | None]:
    """(length, share of stop words); the share is unknown where most letters
    are of a script without stop words here. Wide letters count twice."""
    n_latin = n_other = n_wide = 0
    if not text.isascii():
        for c in text:
            if c.isalpha():
                n_latin, n_other, n_wide = n_latin + (c < "\u0250"), n_other + (c >= "\u0250"), n_wide + (c >= "\u2e80")
    if n_other > n_latin:
        return len(text) + n_wide, None
    words = WORDS.findall(text.lower())
    return len(text) + n_wide, sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def held(found: list[Block], prose: list[int], most_links: float = 0.5) -> list[bool]:
    """Whether each block is in an element whose mark holds.

    A mark holds unless the page has no text outside marked elements, that is
    no block in an article, none of prose and none that ends as a sentence
    does. Then marks of tags such as nav, footer and aside, of comments and of
    what is hidden still hold, others only where they hold no prose: a form or
    a box around the whole page. An element without an end marks its first
    block only.
    """
    first = [e is not None and not e.closed and e.first == i for i, (_, _, e, _) in enumerate(found)]
    inside: list[bool] = []
    for i, (_, _, e, _) in enumerate(found):
        while e is not None and not e.closed:
            e = e.up
        inside.append(e is not None or first[i])
    for i, (t, links, _, article) in enumerate(found):
        if not inside[i] and (prose[i] or article == 1 or (2 * links <= len(t) and t[-1] in ".!?…。！？")):
            return inside
    total = [0]
    for n in prose:
        total.append(total[-1] + n)
    out = []
    for i, (_, _, e, _) in enumerate(found):
        holds = first[i]
        while e is not None and not holds:
            holds = e.closed and (e.sure or total[min(e.last, len(prose))] == total[e.first])
            e = e.up
        out.append(holds)
    return out


def classify(found: list[Block], most_links: float = 0.5, short: int = 70, some_stop: float = 0.1, many_stop: float = 0.25) -> list[bool]:
    """Whether each block is text, by the two passes."""
    facts = [densities(b[0]) for b in found]
    dense = [b[1] / n if (n := len(b[0])) else 0.0 for b in found]
    # Stop words speak only where the page outside of marks has some.
    known = any(stop is not None and stop >= some_stop and n >= short for (n, stop), (_, _, e, _) in zip(facts, found) if e is None or not e.closed)
    facts = [(n, many_stop if stop is None or not known else stop) for n, stop in facts]
    prose = [n if n >= short and stop >= some_stop and links <= most_links else 0 for (n, stop), links in zip(facts, dense)]
    sizes = [n for n, _ in facts]
    marked = held(found, prose)
    inside = sum(n for n, b, m in zip(sizes, found, marked) if b[3] == 1 and not m)
    outside = sum(n for n, b, m in zip(prose, found, marked) if b[3] != 1 and not m)
    starts = next((i for i, (b, m) in enumerate(zip(found, marked)) if b[3] == 1 and not m), None)
    whole = starts is not None and inside >= outside  # the article holds the prose of the page
    # The title of a page stands in or above the article.
    found = [(t, n, e, 1 if a == 1 or (a == 2 and whole and i < starts) else 0) for i, (t, n, e, a) in enumerate(found)]
    labels: list[bool | None] = []
    for (n, stop), links, (_, _, _, article), mark in zip(facts, dense, found, marked):
        article = bool(article) and whole
        score = 0
        if links > most_links:
            score -= 2
            if article and stop >= some_stop:
                score += 2 + (n >= short and stop >= many_stop)
        elif n >= short:
            score += (stop >= some_stop) + (stop >= many_stop) + article
        if whole and not article:
            score -= 3
        if mark:
            score -= 4
        labels.append(None if score == 0 else score > 0)
    border = whole
    ahead: list[tuple[int, bool]] = [(0, border)] * len(labels)
    near = (len(labels), border)
    for i in range(len(labels) - 1, -1, -1):
        ahead[i] = near
        if labels[i] is not None and not marked[i]:
            near = (i, border if whole and not found[i][3] else bool(labels[i]))
        elif not whole and marked[i]:
            near = (i, False)
    out, before = [], (-1, border)
    for i, label in enumerate(labels):
        if label is None:
            after = ahead[i]
            if before[1] == after[1]:
                label = before[1]
            else:
                gap = (i - before[0]) - (after[0] - i)
                label = True if gap == 0 else (before[1] if gap < 0 else after[1])
        elif not marked[i]:
            before = (i, border if whole and not found[i][3] else label)
        elif not whole:
            before = (i, False)
        out.append(bool(label))
    if not any(out):  # a short page: what nothing speaks against is its text
        out = [label is None and not mark and links <= most_links for label, mark, links in zip(labels, marked, dense)]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, good in zip(found, classify(found)) if good)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(v.as_py()) for v in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return pages.select(page_id, url, F.col(page)).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
