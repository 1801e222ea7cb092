"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs its characters outside links. The weights
are summed over a sliding window of lines: where the sum rises to ``SURGE`` text begins, where a whole window is empty
it ends. Text between such a surge and dive is kept, however small beside other stretches; where no window rises so
far, all lines that weigh something.

What the markup says only changes weights. A line of an ``article`` or ``main`` weighs ``IN_MAIN`` more; the more of
the page's weight articles hold, the less weighs a line outside them, up to ``OUTSIDE``. What is no text at all
(scripts, forms), what elements or names declare to be a menu, header, footer, sidebar, notice, advert or reader
comments, and what follows a heading such as "3 comments" weighs nothing, as such a line may read like any other. A
class or id declares that where its last word says it and the others are no more than places or parts
(``post-comments``, ``page_footer``); where others say more (``share-price-notice``), the line weighs ``SURGE`` less. A
line that is one link, outside lists, stays where text goes on around it. An article in a sidebar, menu, footer or
comments section that is closed later on is none of the page's.

Time is linear in the page's length, whatever its markup.

Defined cases: null, empty or textless html gives an empty text; markup cut off or badly nested is read as far as
it goes; html without tags is one line; repeated rows are read each; an empty table gives no rows;
pages of any length are read whole.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from clauseworks.llm.chunks import small_batches

#: Lines in a window; characters in a window where text begins; what a line in an article weighs more.
WINDOW = 3
SURGE = 80
IN_MAIN = 70
#: What a line outside articles weighs less, where these hold half of the weight or more; in part, where they hold less.
OUTSIDE = 240

# Elements by what they do, and the words by which a class or id names what is not the main text.
RAW = "script|style|noscript|template|svg|iframe|object|canvas|title|textarea|select"
NEVER = frozenset("nav footer aside form button dialog menu".split())
NEVER_OUTSIDE = frozenset(["header"])
MAIN = frozenset("article main".split())
BESIDE = frozenset("aside nav footer".split())
BESIDE_ROLES = frozenset("complementary navigation contentinfo".split())
BESIDE_NAMES = frozenset("comment comments reply replies respond disqus related recommended".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SHORT = frozenset("p li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar
    aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice
    notices gdpr alert popup modal overlay newsletter subscribe signup login comment comments respond reply replies
    disqus share sharing social related recommended pagination pager widget toolbar skip copyright""".split()
)
PLACES = frozenset(
    """article area bar block bottom box container content desktop global group inner item items left link links list main mobile
    outer page post posts primary right row secondary section site small sticky top user wrap wrapper""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

_REST = r"""(?:\s(?:"[^"]*"|'[^']*'|[^'"<>])*)?"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>{_REST}/?)>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^<>]*>?", re.I) for tag in RAW.split("|")}
_NAME = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_COMMENTS = re.compile(
    r"(?:\d+\s*|leave an?\s+|reader\s+|user\s+)?(?:comments?|replies|reply|responses|kommentare?|commentaires?|comentarios?)\s*(?:\(?\d+\)?)?\s*:?", re.I
)
_HIDDEN = re.compile(r"\shidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def _tokens(html: str) -> Iterator[tuple[str | None, str, bool, str, int]]:
    """(text, tag, whether it ends, attributes, place) of texts and tags in turn; raw elements are passed over."""
    at = 0
    while m := _TOKEN.match(html, at):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in _RAW_END:
            if not m["end"] and not m["rest"].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else len(html)
        elif tag or m["text"] is not None:
            yield m["text"], tag, bool(m["end"]), m["rest"] or "", m.start()


def _names(rest: str) -> Iterator[tuple[str, list[str]]]:
    """(class, id or role; its words) of each name that is given in attributes."""
    for kind, *value in _NAME.findall(rest):
        for word in "".join(value).lower().split():
            parts = [p for p in re.split("[_-]+", word) if p]
            if parts and parts[0] not in ("has", "no", "with", "without"):
                yield kind.lower(), parts


def _unwanted(tag: str, rest: str, in_main: bool, by_name: bool) -> bool:
    if tag in NEVER or tag in NEVER_OUTSIDE and not in_main:
        return True
    if not by_name or not rest:
        return False
    if tag in MAIN or tag in ("html", "head", "body"):
        return tag == "article" and any(parts[-1] in ("comment", "comments") for _, parts in _names(rest))
    if _HIDDEN.search(rest):
        return True
    return any("-".join(parts) in ROLES if kind == "role" else parts[-1] in NAMES and _declares(parts) for kind, parts in _names(rest))


def _declares(parts: list[str]) -> bool:
    return all(p in NAMES or p in PLACES or p.isdigit() for p in parts)


def _hinted(tag: str, rest: str) -> bool:
    """Whether a name ends like that of an unwanted part, and says more."""
    return bool(rest) and tag not in MAIN and any(kind != "role" and parts[-1] in NAMES and not _declares(parts) for kind, parts in _names(rest))


def _beside(tag: str, rest: str, by_name: bool) -> bool:
    """Whether an unwanted element may hold articles of its own, which are not the page's: teasers or comments."""
    if tag in BESIDE or not by_name:
        return tag in BESIDE
    return any("-".join(parts) in BESIDE_ROLES if kind == "role" else parts[0] in BESIDE_NAMES or parts[-1] in BESIDE_NAMES for kind, parts in _names(rest))


def _closed(html: str) -> set[int]:
    """Places of the start tags that have an end tag."""
    found: set[int] = set()
    opened: dict[str, list[int]] = {}
    for _, tag, ends, rest, at in _tokens(html):
        if tag and not ends:
            if tag not in VOID and not rest.endswith("/"):
                opened.setdefault(tag, []).append(at)
        elif tag and opened.get(tag):
            found.add(opened[tag].pop())
    return found


class _Open:
    """An open element: what it adds to the counts while it is open."""

    __slots__ = ("at", "bad", "beside", "blocks", "ends", "good", "hinted", "live", "tag", "within")

    def __init__(self, tag: str, bad: bool, good: bool, beside: bool, hinted: bool, at: int, blocks: int):
        self.tag, self.bad, self.good, self.beside, self.hinted, self.at = tag, bad, good, beside, hinted, at
        self.blocks = blocks  # blocks among the elements around it
        self.live = True  # an inline element ends before the blocks in it do: then it stays on the stack, and counts no more
        self.ends = self.within = False


class _Stack:
    """The open elements. Each is put there and taken away once, and no tag looks further than at what it closes."""

    def __init__(self, html: str):
        self._html, self._all = html, []
        self._by_tag: dict[str, list[_Open]] = {}
        self.blocks = self.unwanted = self.main = self.links = self.hints = self.items = 0
        self._closed: set[int] | None = None
        self._judged = 0  # so many from the bottom know whether they end, and whether they are beside the main text

    def _count(self, e: _Open, by: int) -> None:
        self.unwanted += by * e.bad
        self.main += by * e.good
        self.links += by * (e.tag == "a")
        self.hints += by * e.hinted
        self.items += by * (e.tag == "li")

    def push(self, tag: str, bad: bool, good: bool, beside: bool, hinted: bool, at: int) -> None:
        e = _Open(tag, bad, good, beside, hinted, at, self.blocks)
        self._all.append(e)
        self._by_tag.setdefault(tag, []).append(e)
        self.blocks += tag not in INLINE
        self._count(e, 1)

    def pop(self) -> None:
        e = self._all.pop()
        self.blocks -= e.tag not in INLINE
        self._judged = min(self._judged, len(self._all))
        if e.live:
            self._by_tag[e.tag].pop()
            self._count(e, -1)

    def close(self, tag: str) -> None:
        """An inline end tag never closes a block that was opened after it; one that closes nothing is passed over."""
        if not self._by_tag.get(tag):
            return
        e = self._by_tag[tag][-1]
        if tag in INLINE and self.blocks > e.blocks:
            e.live = False
            self._by_tag[tag].pop()
            self._count(e, -1)
            return
        while e.live and self._all[-1] is not e:
            self.pop()
        self.pop()

    def end_paragraph(self, tag: str) -> None:
        """A paragraph ends where the next block begins, and takes its open inline elements with it."""
        while self._all and ((top := self._all[-1].tag) in INLINE or top == "p" or top == tag and tag in SHORT):
            self.pop()

    def begin_article(self) -> None:
        """An article does not begin in a menu: that was never closed. In one that is closed later on, it is not the page's."""
        if self._closed is None:
            self._closed = _closed(self._html)
        for i in range(self._judged, len(self._all)):
            e, around = self._all[i], self._all[i - 1] if i else None
            # an element whose end tag is optional ends with the one around it
            e.ends = e.at in self._closed or e.tag in SHORT and around is not None and around.ends
            e.within = around is not None and around.within or e.beside and e.ends
        self._judged = len(self._all)
        while self._all and self.unwanted and not self._all[-1].within:
            self.pop()


def lines_of(html: str, by_name: bool = True) -> list[tuple[str, int, bool, bool]]:
    """(text, weight, whether in article or main, whether it may stay without a weight) of each block, in order.

    Unwanted lines weigh nothing and may not stay. ``by_name``: whether classes and ids count, and not only elements.
    """
    lines: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked, said = 0, 0
    stack = _Stack(html)
    comments: tuple[int, int] | None = None  # the level of the heading that begins them, and the blocks around it

    def close_line(heading: int = 0) -> None:
        nonlocal linked, said, comments
        text = " ".join(_html.unescape("".join(parts)).split())
        if comments and (stack.blocks < comments[1] or 0 < heading <= comments[0]):
            comments = None
        if heading > 1 and said >= SURGE and _COMMENTS.fullmatch(text):
            comments = (heading, stack.blocks - 1)
        unwanted = stack.unwanted or comments is not None
        if text and not (stack.main and unwanted):  # what an article holds that is none of it does not part it
            weight = 0 if unwanted else max(0, len(text) - linked - SURGE * (stack.hints > 0))
            lines.append((text, weight, stack.main > 0 and not unwanted, not (unwanted or stack.hints or stack.items)))
            said += weight
        parts.clear()
        linked = 0

    for text, tag, ends, rest, at in _tokens(html):
        if text is not None:
            parts.append(text)
            if stack.links:
                linked += len(text.strip())
            continue
        if tag not in INLINE or tag == "br":
            close_line(int(tag[1]) if ends and tag in HEADINGS else 0)
        if ends:
            stack.close(tag)
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        good = tag in MAIN
        bad = _unwanted(tag, rest, stack.main > 0, by_name)
        if good and not bad and stack.unwanted and not stack.main:
            stack.begin_article()
        if tag not in INLINE:
            stack.end_paragraph(tag)
        stack.push(tag, bad, good and not bad, bad and _beside(tag, rest, by_name), by_name and not bad and _hinted(tag, rest), at)
    close_line()
    return lines


def weights_of(lines: list[tuple[str, int, bool, bool]]) -> list[int]:
    inside = sum(w for _, w, m, _ in lines if m)
    less = min(OUTSIDE, 2 * OUTSIDE * inside // max(1, sum(w for _, w, _, _ in lines)))
    return [w + IN_MAIN if m else max(0, w - less) for _, w, m, _ in lines]


def main_text(html: str | None) -> str:
    lines = lines_of(html or "")
    if not any(w for _, w, _, _ in lines):  # a name may stand on what holds the whole page
        lines = lines_of(html or "", False)
    weights = weights_of(lines)
    n = len(lines)
    wanted: list[int] = []
    i = 0
    while i < n:
        if not weights[i] or sum(weights[i : i + WINDOW]) < SURGE:
            i += 1
            continue
        end = i  # the surge; the dive is where a whole window weighs nothing
        while end < n and any(weights[end : end + WINDOW]):
            end += 1
        # a line that is all links goes with the text around it
        wanted += [k for k in range(i, end) if weights[k] or lines[k][3] and not lines[k][1]]
        i = end
    return " ".join(lines[k][0] for k in wanted or [k for k in range(n) if lines[k][1]])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row a row of ``pages``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
