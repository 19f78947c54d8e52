"""Main text of web pages by line-block distribution (operator 13).

Markup is stripped to lines, one for each block of the page.  A line weighs the
length of its own text; lines of menus, forms, adverts and other parts that their
markup names, and lines that are mostly links, weigh nothing.  The weights are
summed over windows of a few lines.  Where the sums rise from zero the text
surges, where they fall back to zero it dives; between the two lies a run
of text.  The heaviest run is the article, with the runs that come near it; runs inside
the page's article or main element need no comparison.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices

#: Lines of a window.
WINDOW = 3
#: A run of text beside the heaviest one stays if it weighs at least this part of it.
NEAR = 0.25
#: A line with more than this part of its text in links is no text.
LINKED = 0.5

# The elements of the public HTML standard by what they mean here.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math canvas object audio video".split())
NO_TEXT = frozenset("nav footer aside form dialog menu search select button datalist label legend fieldset".split())
#: Elements whose start ends an open one of the same group.
ENDS = {t: g for g in (("li",), ("dd", "dt"), ("option", "optgroup"), ("tr",), ("td", "th"), ("thead", "tbody", "tfoot")) for t in g}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())

# Words of class names and ids that say what a part of a page is.
BOILERPLATE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs masthead topbar header footer colophon copyright legal sidebar aside widget widgets
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin login register paywall
    search searchbox form social share sharing sharebar related recommended recommendations recommendation trending popular teaser teasers
    comment comments commentlist disqus respond responses reply replies discussion pagination pager toolbar skip skiplink hidden""".split())
#: Before such a word ("has-sidebar", "no-comments") the word tells of the layout only.
LAYOUT = frozenset("has no with without show hide is".split())
COMMENTS = frozenset("comment comments commentlist disqus respond responses reply replies discussion".split())

# Text between tags, comments, declarations, a whole tag with its attributes, or a lone "<".
_TOKEN = re.compile(r"""[^<]+|<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*(?:>|\Z)|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s/>"']|\Z)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in RAW}
_NOTICE = re.compile(r"(?:©|\(c\) ?(?=\d)|copyright\b|all rights reserved)|.*\ball rights reserved\b", re.I)
_COMMENT_HEAD = re.compile(r"(?:\d+ )?(?:comments?|responses|replies|leave a (?:reply|comment)|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\))?[:.]?", re.I)


def says(attributes: dict[str, str]) -> str:
    """Which boilerplate word a part's class, id or role has; empty without one."""
    if attributes.get("role", "").lower() in ROLES:
        return "role"
    for kind in ("id", "class"):
        for name in attributes.get(kind, "").split():
            before = ""
            for word in _WORDS.findall(name):
                word = word.lower()
                if word in BOILERPLATE and before not in LAYOUT:
                    return word
                before = word
    return ""


class Part:
    """An open element: its name, the dead part and the article that it lies in, whether that is an article element, and whether this is a dead part inside a line."""

    __slots__ = ("dead", "inside", "kind", "mute", "name")

    def __init__(self, name: str, dead: int, kind: int, inside: bool, mute: bool = False):
        self.name, self.dead, self.kind, self.inside, self.mute = name, dead, kind, inside, mute


class Lines:
    """The lines of a page: text, characters in links, the dead part it lies in (0: none) and the article element it lies in (0: none)."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.linked: list[int] = []
        self.dead: list[int] = []
        self.article: list[int] = []
        self.reasons = [""]  # of each dead part
        self.holds: set[int] = set()  # dead parts with an article or main element inside
        self.within = [0]  # of each article: the main element that it lies in
        self.titled: set[int] = set()  # with a main heading inside
        self._buffer: list[str] = []
        self._links = 0
        self._open = [Part("", 0, 0, False)]
        self._anchor = 0  # open links
        self._read(page)

    def _read(self, page: str) -> None:
        at, end, match = 0, len(page), _TOKEN.match
        while at < end:
            m = match(page, at)
            at = m.end()
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if self._open[-1].mute:
                    continue
                self._buffer.append(piece)
                if self._anchor:
                    self._links += len(piece)
                continue
            if piece[1] in "!?":
                continue
            name = _NAME.match(piece)[1].lower()
            if piece[1] == "/":
                self._close(name)
            elif name in RAW and not piece.endswith("/>"):
                at = _RAW_END[name].search(page, at).end()
            elif name not in RAW:
                self._start(name, piece)
        self._line()

    def _line(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            if text:
                top = self._open[-1]
                self.text.append(text)
                self.linked.append(self._links)
                self.dead.append(top.dead)
                self.article.append(top.kind)
            self._buffer = []
        self._links = 0

    def _start(self, name: str, tag: str) -> None:
        if name == "br" or name == "wbr" or name == "img":
            if name == "br":
                self._buffer.append(" ")
            return
        if name == "a":
            self._anchor = 1  # links do not nest
        elif name in BLOCKS:
            self._line()
            self._anchor = 0
            if self._open[-1].name == "p":
                self._open.pop()
            group = ENDS.get(name)
            if group:
                # up to the list or table that they are in
                for k in range(len(self._open) - 1, 0, -1):
                    other = self._open[k].name
                    if ENDS.get(other) == group:
                        del self._open[k:]
                        break
                    if other in ("ul", "ol", "dl", "table", "menu", "select", "div", "article", "section"):
                        break
            if self._open[-1].name == "head" and name != "head":
                self._open.pop()
        if name in VOID:
            return
        top = self._open[-1]
        dead, kind, inside = top.dead, top.kind, top.inside
        reason = ""
        if not dead:
            attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(tag)} if len(tag) > len(name) + 2 else {}
            if name in NO_TEXT or name == "header" and not top.kind:
                reason = name
            elif name == "head" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(attributes.get("style", "")):
                reason = "head"
            elif attributes and name not in ("html", "body", "main", "a"):
                reason = says(attributes)
                if name == "article" and not top.inside and reason not in COMMENTS:
                    reason = ""
                if reason == "header" and top.kind:
                    reason = ""
            if reason:
                self.reasons.append(reason)
                dead = len(self.reasons) - 1
        remark = self.reasons[dead]
        if name in ("article", "main") and remark not in COMMENTS and remark != "head":
            self.holds |= {p.dead for p in self._open if p.dead}
            if not inside:  # an article inside another is a part of it
                self.within.append(kind)
                kind, inside = len(self.within) - 1, name == "article"
        elif name == "h1":
            self.titled |= {p.dead for p in self._open if p.dead}
        if name in BLOCKS or dead != top.dead:
            self._open.append(Part(name, dead, kind, inside, name not in BLOCKS))

    def _close(self, name: str) -> None:
        if name == "a":
            self._anchor = 0
        if name == "br":
            self._buffer.append(" ")
        if name in BLOCKS:
            self._line()
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].name == name:
                del self._open[k:]
                return
            if name not in BLOCKS and self._open[k].name in BLOCKS:
                return


def runs(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge of the window sums and the dive after it."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))  # sums[i]: the window that ends at line i
    some = sums > 0
    surge = np.flatnonzero(some & ~np.r_[False, some[:-1]])
    dive = np.flatnonzero(some & ~np.r_[some[1:], False])
    return [(int(a), int(min(b - window + 2, len(weights)))) for a, b in zip(surge, dive, strict=True)]


def main_text(page: str | None) -> str:
    """The blocks of a page's article, joined by line ends."""
    if not page:
        return ""
    lines = Lines(page)
    n = len(lines.text)
    size = np.fromiter(map(len, lines.text), np.int64, n)
    dead = np.array(lines.dead, dtype=np.int64)
    kind = np.array(lines.article, dtype=np.int64)
    for main in {k for k in lines.within if k}:
        if lines.within.count(main) == 1:  # a main element and its only article are one
            kind[kind == lines.within.index(main)] = main
    plain = np.where(np.array(lines.linked, dtype=np.int64) > LINKED * size, 0, size)
    # a marked part is the article's frame if it holds the article, or most of the text with the title or with hardly any text beside it
    total, alive = plain.sum(), plain[dead == 0].sum()
    for part, reason in enumerate(lines.reasons):
        if not part or reason == "head" or reason in COMMENTS:
            continue
        most = not kind.any() and 2 * plain[dead == part].sum() > total
        if part in lines.holds or most and (part in lines.titled or 10 * alive < total):
            dead[dead == part] = 0
    weight = np.where(dead > 0, 0, plain)
    after = False
    for i, text in enumerate(lines.text):
        if kind[i]:
            continue
        after = after or _COMMENT_HEAD.fullmatch(text) is not None
        if after or _NOTICE.match(text):
            weight[i] = 0
    articles = np.bincount(kind, weights=weight)
    if len(articles) > 1 and articles[1:].any():
        best = int(articles[1:].argmax()) + 1
        weight[kind != best] = 0
    found = runs(weight)
    if not found:
        return ""
    heavy = [int(weight[a:b].sum()) for a, b in found]
    least = 0 if kind.any() and articles[1:].any() else NEAR * max(heavy)
    out = []
    for (a, b), w in zip(found, heavy, strict=True):
        if w >= least:
            out += [lines.text[i] for i in range(a, b) if weight[i]]
    return "\n".join(out)


def extract(pages: DataFrame, html_column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of each row's page in column ``to`` (replaced, if it is there).

    Character references are decoded, white space inside a block becomes one blank,
    blocks are joined in page order by one line end; nothing is dropped for its
    length.  A null or empty page, and one without text, gives an empty text.  Broken markup is
    read as browsers do: tags may stay open, attributes may hold ``>``.  All other
    columns, nulls and repeated rows pass through; an empty table gives an empty result.
    Pages do not depend on each other: no shuffle, and the time grows with a page's length."""
    ship(pages.sparkSession)
    rows = pages.drop(to) if to != html_column else pages
    source = "_page" if "_page" not in rows.columns else "_page_" + "_".join(rows.columns)
    rows = rows.withColumn(source, F.col(html_column).cast("string"))
    place = len(rows.columns) - 1
    kept = [i for i, c in enumerate(rows.columns[:-1]) if c != to]
    schema = ", ".join([f"`{rows.schema[i].name}` {rows.schema[i].dataType.simpleString()}" for i in kept] + [f"`{to}` string"])

    def run(batches):
        for part in text_slices(batches, place):
            texts = pa.array([main_text(p) for p in part.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), texts], names=[*(part.schema.names[i] for i in kept), to])

    return rows.mapInArrow(run, schema)
