"""The main text of web pages: paragraphs score their ancestors, and the best container is kept with siblings like it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element that begins ends, and what that doesn't reach across.
ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul".split(), ({"p"}, "li dd dt td th table button caption".split())),
    "li": ({"li", "p"}, "ul ol menu dir td th table".split()), "dt": ({"dt", "dd", "p"}, "dl td th table".split()), "dd": ({"dt", "dd", "p"}, "dl td th table".split()),
    "option": ({"option"}, "select".split()), "tr": ({"tr", "td", "th"}, "table".split()), "td": ({"td", "th"}, "table tr".split()), "th": ({"td", "th"}, "table tr".split()),
    **dict.fromkeys("tbody thead tfoot".split(), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, "table".split())), "a": ({"a"}, "td th table".split()), "body": ({"head"}, []),
}
#: Elements whose content is no running text of an article.
DROPPED = frozenset("aside button canvas datalist dialog embed fieldset footer head input label map math menu meter nav object option audio video progress search select svg template".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that tell what stands around an article, and those that tell the article.
AROUND = frozenset(
    "ad ads adbox adsbygoogle adslot adsense adunit adv advert adverts advertisement advertising advertorial alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist commentary consent cookie cookies copyright crumbs "
    "disclaimer discussion disqus feedback footer gdpr guestbook header login masthead menu menus modal nav navbar navigation navmenu newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promos promotion "
    "rail recommendations recommended register related replies reply respond responses search share sharebar sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget widgets".split()
)
INSIDE = frozenset("article articlebody body content entry main post story text".split())

#: So many elements above a block get points.
LEVELS = 6

_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|[!?/][^>]*+>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAIL = re.compile(r"<[a-zA-Z/!?]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Page:
    """A page as elements (parents before their children) and blocks: text between the begins and ends of block elements."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes = ["#"], [-1], [""]
        #: Of each block its element, its text, and how many characters of links it has.
        self.blocks: list[tuple[int, str, int]] = []
        self._open, self._text, self._linked = [0], [], 0
        #: How many elements of each kind are open, so that only those that are there are looked for.
        self._now: dict[str, int] = {}
        #: Open inline elements whose text is none of the article's.
        self._mute: set[int] = set()
        self._read(html)

    def _read(self, html: str) -> None:
        last = html.rfind(">") + 1
        at, end = 0, len(html)
        tail = _TAIL.search(html, last)
        comment = html.rfind("<!--", 0, last)
        if tail and (comment < 0 or html.find("-->", comment) >= 0):
            end = tail.start()  # a tag that the page's end cuts off
        while m := _TAG.search(html, at, end):
            if m.start() > at:
                self._say(html[at : m.start()])
            at, tag = m.end(), m[2] and m[2].lower()
            if not tag:
                continue
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                close = _RAW_END[tag].search(html, at)
                at = end if close is None else close.start()
                if tag in ("iframe", "textarea"):
                    self._say(" ")
            else:
                self._begin(tag, m[3])
        if at < end:
            self._say(html[at:end])
        self._flush()

    def _close(self, first: int, last: int | None = None) -> None:
        for i in self._open[first:last]:
            self._now[self.tags[i]] -= 1
            self._mute.discard(i)
        del self._open[first:last]

    def _say(self, raw: str) -> None:
        if self._mute:
            return
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._now.get("a"):
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                # the element that the text stands in: no inline one
                at = next(i for i in reversed(self._open) if i == 0 or self.tags[i] in BLOCK)
                self.blocks.append((at, text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        block = tag in BLOCK
        if block:
            self._flush()
        ended, within = ENDS.get(tag, ((), ()))
        if any(self._now.get(t) for t in ended):
            for k in range(len(self._open) - 1, 0, -1):
                name = self.tags[self._open[k]]
                if name in ended:
                    if tag == "a":
                        self._close(k, k + 1)
                        break
                    self._flush()
                    self._close(k)
                elif name in within:
                    break
        if tag in HEADING and self.tags[self._open[-1]] in HEADING:
            self._close(len(self._open) - 1)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.attributes.append(attributes)
        if tag not in VOID and not (attributes.endswith("/") and not block and tag != "a"):
            self._open.append(len(self.tags) - 1)
            self._now[tag] = self._now.get(tag, 0) + 1
            if not block and (tag in DROPPED or attributes and (_hidden((named := _named(attributes))[1]) or named[0] & AROUND)):
                self._mute.add(len(self.tags) - 1)

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        for k in range(len(self._open) - 1, 0, -1) if self._now.get(tag) else ():
            name = self.tags[self._open[k]]
            if name == tag:
                self._close(k, None if tag in BLOCK else k + 1)
                return
            if name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html", "article", "main", "div", "section"):
                return


def _named(attributes: str) -> tuple[set[str], dict[str, str]]:
    """The words of class, id and what the element is said to be; the attributes."""
    if not attributes or attributes.isspace():
        return set(), {}
    found = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)}
    return {w.lower() for k in ("class", "id", "itemprop", "itemtype") if k in found for w in _NAME.findall(found[k])}, found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _around(page: Page) -> list[bool]:
    """Which elements hold no text of the article, by what they are or are called.

    A name may also be that of a frame around all ("with-sidebar"). So an element is kept, whatever it is called, if all
    articles and main parts lie in such ones and the largest lies in it; or if it has over half of the page's text, a
    headline or an element that is called content, article or the like.
    """
    n, tags, parents = len(page.tags), page.tags, page.parents
    names = [_named(a) for a in page.attributes]
    size, heads = [0] * n, [False] * n
    for at, text, _ in page.blocks:
        size[at] += len(text)
    for i in range(n - 1, 0, -1):
        up, words = parents[i], names[i][0]
        heads[i] |= tags[i] == "h1" or bool(words & INSIDE and not words & AROUND)
        size[up] += size[i]
        heads[up] |= heads[i]
    out, article, named = [False] * n, [False] * n, [False] * n
    framed = []
    for i in range(1, n):
        above, tag, (words, attributes) = parents[i], tags[i], names[i]
        article[i] = article[above] or tag in ("article", "main")
        own_head = article[above] or words & INSIDE  # an article's own header
        named[i] = bool(words & (AROUND - {"header"} if own_head else AROUND)) and tag not in ("html", "body")
        out[i] = out[above] or tag in DROPPED or _hidden(attributes) or tag == "header" and not article[above] or tag == "form" and 2 * size[i] <= size[0] or attributes.get("role") in ROLES
        if (tag in ("article", "main") or attributes.get("role") == "main") and not words & AROUND and size[i]:
            framed.append(i)
    kept = {0}
    under = [False] * n
    for i in range(1, n):
        under[i] = under[parents[i]] or named[i] or out[i]
    if framed and all(under[parents[i]] for i in framed):
        largest = max(framed, key=lambda i: (size[i], -i))
        while largest > 0:
            kept.add(largest)
            largest = parents[largest]
    for i in range(1, n):
        called = named[i] and i not in kept and not (2 * size[i] > size[0] and heads[i])
        out[i] = out[i] or out[parents[i]] or called
    return out


def main_text(html: str) -> str:
    """The article's blocks, joined by two \\n; empty if there are none.

    What an element's tag, role or name tells to stand around articles (menus, headers, footers, forms ...) goes first. Each
    block then passes points to its ancestors: up to 1 for 25 characters, up to 3 for each 100, and 1 a comma, less its
    share of links; the element around it gets them whole, the next half, the four above a third, a sixth and so on. An
    element's points count less the more of its text is links. The best one is widened to the article, main part or
    content element around it. Siblings stay that are headings before it, have a fifth of its points, or
    (where no such element was found) are sentences without links; lists of links inside go.
    """
    page = Page(html)
    around = _around(page)
    blocks = [b for b in page.blocks if not around[b[0]]]
    if not blocks:
        return ""
    n, tags, parents = len(page.tags), page.tags, page.parents
    score, size, linked = [0.0] * n, [0] * n, [0] * n
    for at, text, links in blocks:
        size[at] += len(text)
        linked[at] += links
        if tags[at] in HEADING:
            continue
        commas = sum(map(text.count, ",،、，；"))
        points = (min(len(text) / 25, 1) + commas + min(len(text) / 100, 3)) * (1 - links / len(text))
        above = at if tags[at] in ("div", "section", "article", "main", "body", "td", "#") else parents[at]
        level = 0
        while above >= 0 and level < LEVELS:
            score[above] += points / (1 if level == 0 else 2 if level == 1 else 3 * (level - 1))
            above, level = parents[above], level + 1
    for i in range(n - 1, 0, -1):
        size[parents[i]] += size[i]
        linked[parents[i]] += linked[i]
    worth = [s * (1 - k / z) if z else 0.0 for s, k, z in zip(score, linked, size, strict=True)]
    best = max(range(n), key=lambda i: (worth[i], -i))
    if not worth[best]:
        best = next((i for i in range(n) if tags[i] in ("article", "main") and not around[i] and size[i]), 0)
    best, told = _widened(page, best)
    chosen = {best, *(_siblings(page, best, told, around, worth, size, linked) if best else ())}
    inside, listed = [False] * n, [False] * n
    links = [0] * n
    for i in range(n - 1, 0, -1):
        links[i] += tags[i] == "a"
        links[parents[i]] += links[i]
    for i in range(n):
        up = parents[i]
        inside[i] = i in chosen or up >= 0 and inside[up]
        listed[i] = up >= 0 and listed[up] or i not in chosen and tags[i] in ("ul", "ol", "div", "section", "table", "dl") and links[i] > 1 and size[i] > 0 and linked[i] > 0.6 * size[i]
    return "\n\n".join(text for at, text, _ in blocks if inside[at] and not listed[at])


def _widened(page: Page, best: int) -> tuple[int, bool]:
    """The article around an element, else its main part, else the outermost element called content or the like; whether there was one."""
    path, i = [], best
    while i > 0:
        path.append(i)
        i = page.parents[i]
    for wanted in ("article", "main"):
        for i in path:
            if page.tags[i] == wanted or wanted == "main" and _named(page.attributes[i])[1].get("role") == "main":
                return i, True
    named = [i for i in path if page.tags[i] not in ("html", "body") and (_named(page.attributes[i])[0] & INSIDE or "articleBody" in page.attributes[i])]
    return (named[-1], True) if named else (best, False)


def _siblings(page: Page, best: int, told: bool, around: list[bool], worth: list[float], size: list[int], linked: list[int]) -> list[int]:
    own = {at: text for at, text, _ in page.blocks}
    out = []
    for i, above in enumerate(page.parents):
        if above != page.parents[best] or i == best or around[i] or not size[i]:
            continue
        plain = 4 * linked[i] < size[i]
        sentence = page.tags[i] in ("p", "blockquote", "pre") and plain and (size[i] > 80 or not linked[i] and own.get(i, "").endswith((".", "!", "?", "。")))
        if page.tags[i] in ("h1", "h2") and i < best or worth[i] >= max(1.0, 0.2 * worth[best]) and plain or not told and sentence:
            out.append(i)
    return out


def extract_main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """pages (its columns `keep`, all but html by default) with text and n_chars, its code points.

    Needs a column html; a null or empty one has the empty text. Columns of the result's names, in any case, are
    replaced, others pass. Every row is read by itself and whole, however long, so repeated rows give equal results; an
    empty table gives no rows. White space inside a block, also what <br> stands for, is one space; blocks stand in
    page order. Ties between containers go to the one that begins first. Nothing is shuffled.
    """
    keep = [c for c in pages.columns if c.lower() != "html"] if keep is None else keep
    df, back = carried(pages, ["html"], ["text", "n_chars"], keep)
    whole = "html" in {c.lower() for c in keep}
    own = [c for c in df.columns if c != "html" or whole]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) if h else "" for h in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), texts, pc.utf8_length(texts).cast(pa.int64())], names=[*own, "_text", "_n"])

    schema = df.select(*own).withColumns({"_text": F.lit(""), "_n": F.lit(0).cast("long")}).schema
    return df.mapInArrow(extracted, schema).select(*back, F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
