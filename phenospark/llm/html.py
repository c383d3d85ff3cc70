"""Operator 7, HTML extraction: minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier, fitted on labelled pages, gives each block the chance to be
content, from what it looks like and what it stands in; the costs of calling it boilerplate and of calling it content are
its capacities to the two terminals. Blocks that follow each other are joined by edges whose capacities, larger the closer
they stand in the document's tree, are the costs of labelling them differently. A maximum flow finds the labelling of least
cost: a doubtful block goes with those around it.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# A quote has its meaning only behind an equals sign; a stray one is part of an attribute's name.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)
_WANTED = ("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop")

# Names of HTML elements.
UNSEEN = frozenset("script style noscript template textarea title iframe object svg math select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTER = frozenset("nav footer aside form dialog menu button head".split())
INNER = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote figure figcaption caption table tbody thead tr td th".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role: those that name boilerplate, content, and neither but the place of things.
BAD = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner banners sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead cookie cookies "
    "consent gdpr notice notices alert alerts popup popups modal overlay comment comments commentary reply replies disqus respond discussion reader readers share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search searchform widget widgets toolbar pagination pager tag tags copyright legal disclaimer skip complementary contentinfo teaser teasers bio info colophon credits".split()
)
#: Those of readers' talk, which however long is no article.
TALK = frozenset("comment comments commentary reply replies disqus respond discussion".split())
GOOD = frozenset("article articlebody post entry content main story body text prose".split())
PLACE = frozenset("list item items box area block section sections wrapper wrap container inner outer site page top bottom left right center global primary secondary links link bar panel row col column group header head form slot unit body author the a js l c u".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Phrases of notices, forms and page furniture.
NOTICE = re.compile(r"cookies?\b|privacy|subscri|newsletter|sign (?:up|in)|log ?in\b|all rights reserved|terms of|advertis|sponsored|share (?:this|on)|follow us|read more|click here|copyright|©|related (?:posts|articles|stories)|leave a (?:comment|reply)|skip to", re.I)

#: Headings of what readers say, and of what else the site has, up to the next heading.
TALK_HEADING = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|responses?|replies|discussion)(?: \(?\d+\)?)?|leave a (?:comment|reply)|join the (?:conversation|discussion)|what do you think", re.I)
MORE_HEADING = re.compile(r"(?:more|other|related|popular|latest|recent|trending|top|featured|recommended)(?: (?:stories|articles|posts|news|content|reading|reads|topics|videos|now|today|for you|from .{1,40}))|related|recommended|trending|you (?:may|might) also (?:like|enjoy).{0,20}|read next|about the authors?|advertisement|tags|categories", re.I)
LONG, SHARE = 25, 0.6

#: What the classifier looks at, with the weights that fit() finds for the labelled pages of the tests (tests/llm/pages.py).
WEIGHTS = {
    "always": 1.13, "boilerplate tag": -6.54, "page header": -5.32, "article": 0.84, "named": -8.19, "named in part": -0.18, "named content": 2.72,
    "in links": -4.34, "length": 2.08, "under four words": -0.17, "ends a sentence": 1.23, "heading": 1.69, "notice": -4.28, "under": -6.56,
}
FEATURES = tuple(WEIGHTS)


@dataclass
class Element:
    tag: str
    parent: Element | None
    bad: float = 0.0  # the share of boilerplate words in its names
    good: bool = False
    hidden: bool = False
    talk: bool = False  # named as readers' talk
    holds: bool = False  # the article, the main part, a first heading or most of the text is inside: a frame around everything
    asked: bool = False  # a first heading inside has been told to those around
    number: int = 0  # in the order of the page
    last: int = 0  # the number of the last element inside
    long: int = 0  # long paragraphs inside
    mass: int = 0  # their words
    inlines: dict[str, int] = field(default_factory=dict)  # open in it, without a block element between
    _seen: tuple | None = None

    def __post_init__(self):
        inner = self.tag in INLINE and self.parent is not None
        # the nearest that is a block element; that has a say in what its text is; that isn't a paragraph, list or table
        self.block = self.parent.block if inner else self
        self.owner = self.parent.owner if inner and not self.bad else self
        self.container = self.parent.container if self.tag in LEAVES and self.parent is not None else self

    def around(self) -> tuple[bool, bool, bool, bool, bool, bool]:
        """Of this element and those around it: boilerplate tag, page header, article, named as boilerplate, named so in
        part, named as content."""
        path, e = [], self
        while e is not None and e._seen is None:
            path.append(e)
            e = e.parent
        up = e._seen if e is not None else (False,) * 6
        for e in reversed(path):
            own = not e.holds
            header = e.tag == "header" and not up[2] and not e.good
            up = (up[0] or (own and e.tag in OUTER), up[1] or (own and header), up[2] or e.tag in INNER, up[3] or (own and e.bad == 1), up[4] or (own and 0 < e.bad < 1), up[5] or e.good)
            e._seen = up
        return self._seen


@dataclass
class TextBlock:
    text: str
    parent: Element
    linked: int  # characters in links
    heading: bool = False
    under: bool = False  # a heading of readers' talk or of other articles
    words: int = field(init=False)

    def __post_init__(self):
        self.words = self.text.count(" ") + 1

    def is_long(self) -> bool:
        return self.words >= LONG and self.linked * 5 < len(self.text) and not self.heading

    def features(self) -> list[float]:
        tag, header, article, named, partly, good = self.parent.around()
        notices = len(NOTICE.findall(self.text)) if self.words < 60 else 0
        return [
            1.0, tag, header, article, named, partly and not named, good, min(1.0, self.linked / max(1, len(self.text))), min(1.0, math.log2(1 + self.words) / 7), self.words < 4,
            self.text[-1:] in ".!?:…。\"'”»", self.heading, min(notices, 2) / 2, self.under,
        ]


def named(names: str) -> tuple[float, bool]:
    """(share of boilerplate words, whether there is a word for content) of class, id and role; places don't count. Of several
    names the most telling counts, and none where one of them names content."""
    worst, good = 0.0, False
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        bad = sum(w in BAD for w in words)
        other = sum(w not in BAD and w not in PLACE for w in words)
        good |= any(w in GOOD for w in words) and not bad
        worst = max(worst, bad / (bad + other) if bad else 0.0)
    return worst, good


def _element(tag: str, attributes: str, up: Element, number: int) -> Element:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        if (a := m[1].lower()) in _WANTED:
            found.setdefault(a, m[2] or m[3] or m[4] or "")
    names = " ".join([found[a] for a in ("class", "id", "role") if a in found])
    bad, good = named(names) if names and tag not in ("html", "body") else (0.0, False)
    good |= found.get("itemprop") == "articleBody"
    hidden = up.hidden or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    if tag in INNER:
        e = up
        while e is not None and not e.holds:
            e.holds, e = True, e.parent
    elif tag == "h1":
        e = up
        while e is not None and not e.holds and not e.asked:
            e.holds, e.asked, e = e.tag not in ("header", "nav", "aside", "footer"), True, e.parent
    talk = bad > 0 and any(w.lower() in TALK for w in _NAME.findall(names))
    return Element(tag, up, bad, good, hidden, talk, number=number)


def blocks(page: str) -> list[TextBlock]:
    """The text blocks of a page in order: runs of text between block elements, white space runs as one blank. Every element is
    opened and closed once, and an end without a beginning costs nothing, so time grows with the page's length."""
    top = Element("", None)
    elements = [top]
    opened: dict[str, int] = {}  # block elements
    here, out, parts, linked, link = top, [], [], 0, 0
    at, owner, filled = 0, top, False

    def add(raw: str) -> None:
        nonlocal linked, owner, filled
        if raw and not here.hidden:
            text = html.unescape(raw)
            if not filled:
                owner = here.owner
                filled = bool(text.strip())
            parts.append(text)
            if link:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked, filled
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(TextBlock(text, owner, min(linked, len(text)), owner.tag in HEADINGS))
            parts.clear()
        linked, filled = 0, False

    def enter(tag: str, attributes: str) -> Element:
        elements.append(_element(tag, attributes, here, len(elements)))
        return elements[-1]

    token = _TOKEN.search(page)
    while token is not None:
        add(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            if token[0].startswith("<![CDATA["):
                add(html.escape(token[0][9:].removesuffix("]]>")))
        else:
            closing, tag, attributes = token[1] == "/", token[2].lower(), token[3] or ""
            if not closing and tag in UNSEEN:
                if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
            elif tag == "br":
                add(" ")
            elif tag in INLINE:
                level = here.block.inlines
                if closing:
                    if level.get(tag, 0):
                        while here.tag != tag:
                            level[here.tag] -= 1
                            here = here.parent
                        level[tag] -= 1
                        here = here.parent
                        link -= tag == "a" and link > 0
                elif tag not in VOID:
                    inner = enter(tag, attributes)
                    if inner.bad:
                        flush()
                    here = inner
                    level[tag] = level.get(tag, 0) + 1
                    link += tag == "a"
            else:
                flush()
                if closing:
                    if opened.get(tag, 0):
                        while here.tag != tag:
                            if here.block is here:
                                opened[here.tag] -= 1
                            here = here.parent
                        opened[tag] -= 1
                        here, link = here.parent, 0
                elif tag not in VOID:
                    # a block element ends an open paragraph, whatever is open in it
                    ends, e = CLOSES.get(tag, set()) | {"p"}, here.block
                    while e.parent is not None and e.tag in ends:
                        opened[e.tag] -= 1
                        here, e = e.parent, e.parent.block
                    link = 0
                    here = enter(tag, attributes)
                    opened[tag] = opened.get(tag, 0) + 1
        token = _TOKEN.search(page, at)
    add(page[at:])
    flush()
    _weigh(elements, out)
    return out


def _weigh(elements: list[Element], found: list[TextBlock]) -> None:
    """Tell elements that hold most of a page's long text, whatever they are called, and blocks under headings of talk."""
    for b in found:
        if b.is_long():
            b.parent.long += 1
            b.parent.mass += b.words
    for e in reversed(elements):
        e.last = max(e.last, e.number)
        if e.parent is not None:
            e.parent.last = max(e.parent.last, e.last)
            e.parent.long += e.long
            e.parent.mass += e.mass
    for e in elements:
        if e.long >= 3 and not e.talk and e.mass >= SHARE * elements[0].mass:
            e.holds = True
    within, talk = None, False
    for b in found:
        if b.heading:
            heading = b.text.rstrip(" :.!?…»")
            talk = TALK_HEADING.fullmatch(heading) is not None
            within = (b.parent.parent or b.parent) if b.parent.tag != "h1" and (talk or MORE_HEADING.fullmatch(heading)) else None
        if within is not None:
            b.under = within.number <= b.parent.number <= within.last and (talk or b.heading or b.words < 2 * LONG)


def chance(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The classifier's chance of content for rows of features."""
    return 1.0 / (1.0 + np.exp(-np.clip(rows @ weights, -30, 30)))


def fit(pages: list[tuple[str, list[str]]], penalty: float = 1.0, steps: int = 50) -> dict[str, float]:
    """WEIGHTS from pages with the texts of their content blocks: logistic regression by Newton steps, on all blocks, those of a
    page weighing 1 together."""
    rows, labels, weight = [], [], []
    for page, content in pages:
        found, left = blocks(page), list(content)
        for b in found:
            rows.append(b.features())
            labels.append(b.text in left)
            weight.append(20.0 / len(found))
            if labels[-1]:
                left.remove(b.text)
    x, y, m = np.array(rows, dtype=float), np.array(labels, dtype=float), np.array(weight)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = chance(x, w)
        w -= np.linalg.solve((x.T * (m * p * (1 - p))) @ x + penalty * np.eye(len(w)), x.T @ (m * (p - y)) + penalty * w)
    return dict(zip(FEATURES, w.tolist(), strict=True))


def costs(found: list[TextBlock], most: float = 6.0) -> list[tuple[float, float]]:
    """Costs of calling each block boilerplate, and of calling it content: what the classifier's chances are against, in
    natural logarithms, at most `most`."""
    if not found:
        return []
    p = chance(np.array([b.features() for b in found], dtype=float), np.array([WEIGHTS[f] for f in FEATURES]))
    return [(min(most, -math.log(max(1 - x, 1e-12))), min(most, -math.log(max(x, 1e-12)))) for x in p.tolist()]


def edges(found: list[TextBlock], adjacency: float = 0.3, container: float = 1.2, near: float = 0.5) -> list[tuple[int, int, float]]:
    """(block, block, cost of labelling them differently): neighbours cost `adjacency`; `container` more where the nearest
    element around both that isn't a paragraph, list or table is one, or `near` where the next around these is. And blocks of one element are
    joined over what stands between them."""
    out, last = [], {}
    for i, b in enumerate(found):
        up = b.parent.container
        over = up.parent or up
        if i:
            out.append((i - 1, i, adjacency))
        if id(up) in last:
            out.append((last[id(up)], i, container))
        elif ("over", id(over)) in last:
            out.append((last["over", id(over)], i, near))
        last[id(up)] = last["over", id(over)] = i
    return out


def min_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each block whether it is on the content side of a minimum cut (maximum flow by Dinic's method)."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, ab: int, ba: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(ab)
        out[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i in range(n):
        a, b = round(content[i] * 1000), round(boiler[i] * 1000)
        both = min(a, b)  # flows from source to sink through this block alone
        if a > both:
            join(source, i, a - both, 0)
        elif b > both:
            join(i, sink, b - both, 0)
    for a, b, c in edges:
        join(a, b, round(c * 1000), round(c * 1000))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 or (content[i] >= boiler[i] and level[i] >= 0) for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:  # blocking flow, one path at a time
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if room[e] == 0)
                path = path[:keep]
                u = to[path[-1]] if path else source
                continue
            while tried[u] < len(out[u]):
                e = out[u][tried[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(out[u]):
                path.append(out[u][tried[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                tried[u] += 1


def labels(found: list[TextBlock]) -> list[bool]:
    """Which blocks are content."""
    both = costs(found)
    return min_cut([c for c, _ in both], [x for _, x in both], edges(found))


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line ends."""
    found = blocks(page or "")
    return "\n".join(b.text for b, c in zip(found, labels(found), strict=True) if c)


def extract_text(pages: DataFrame, html_column: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `out`, the main text of each whole page: content blocks in page order, one on each line.

    Scripts, styles, forms' fields and what is hidden never count as text; character references are decoded; white space
    inside a block becomes one blank. A null, empty or blank page, and one without content, has an empty text. One
    narrow pass; a page is worked on by itself, so repeated rows repeat their result. `keep`: the columns that go along
    (all but the html, unless given); a column of the name `out` is replaced.
    """
    kept = [c for c in (pages.columns if keep is None else keep) if c != out and (keep is not None or c != html_column)]
    rows = pages.select(*kept, F.col(html_column).alias("__html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, out])

    return rows.mapInArrow(run, schema)
