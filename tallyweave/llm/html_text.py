"""Main text of HTML pages.

The standard library's parser reports a page as a stream of events; they become
lines, one per block of text, each with its text-to-tag ratio.  The ratios are
smoothed with a Gaussian and split into two clusters; regions that hold a line
of the upper cluster are the content, with what belongs to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul head script style template noscript iframe select textarea button".split()
)
NEVER = frozenset("nav footer aside script style template noscript iframe object svg canvas select textarea button head title menu dialog search datalist".split())
CONTAINER = frozenset("article main section div td body blockquote figure ul ol dl table form header".split())
HEADING = frozenset("h1 h2 h3".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebars?|aside|footer\w*|masthead|header|topbar|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe\w*|signup|login|share\w*|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|respond|replies|disqus|pagination|pager|tags|toolbar|widgets?|skip|hidden|copyright|legal)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Of these, the names of what is not the article however much text it has.
APART = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|share\w*|sharing|comments?|commentlist|respond|replies|disqus)(?:$|[\s_-])", re.IGNORECASE)
#: How a sentence ends.
SENTENCE_END = re.compile(r"[.!?\u2026\u3002][\"'\u00bb\u201c\u201d\u2019)\]]*\Z")
#: Class names that say what an element has or is about, not what it is.
MODIFIER = re.compile(r"(?:has|no|not|with|without|category|tag|layout|article|entry|post)[_-]+(?!comments?\Z|comments?[_-])", re.IGNORECASE)
#: Start tags that imply the end of an open element: which elements they end, and which bound the search for them.
SCOPE = frozenset("table caption button object template".split())
IMPLIED = {
    **{t: (frozenset({"p"}), SCOPE | {"td", "th"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()},
    "li": (frozenset({"li"}), SCOPE | {"ul", "ol", "menu", "dir", "td", "th"}),
    **{t: (frozenset({"dt", "dd"}), SCOPE | {"dl", "td", "th"}) for t in ("dt", "dd")},
    **{t: (frozenset({"td", "th"}), frozenset({"table", "tr"})) for t in ("td", "th")},
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **{t: (frozenset({"option"}), frozenset({"select", "datalist"})) for t in ("option", "optgroup")},
    "a": (frozenset({"a"}), SCOPE | {"td", "th"}),
}
#: Elements whose text is prose: a form that holds none of them is a form and no wrapper.
PROSE = frozenset("article main p h1 h2 h3 blockquote".split())
TAG_START = re.compile(r"<[a-zA-Z/!?]")
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


@dataclass
class Line:
    """One block of text: the tags and link characters in it, and where it stands."""

    text: str
    tags: int
    linked: int
    region: int
    bound: int
    furniture: bool
    heading: bool
    mark: int

    @property
    def plain(self) -> int:
        """Characters outside links."""
        return max(len(self.text) - self.linked, 0)


@dataclass
class Open:
    """An open element and what its text is part of."""

    name: str
    furniture: bool
    bound: int  # 2 in an article element, 1 in a main element, else 0
    mark: int
    region: int


class LineReader(HTMLParser):
    """Turns parser events into lines; holds the open elements only.

    ``places`` has the positions of the open elements by name, and ``blocks``
    those of the block elements, so that no event looks through all of them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = [Open("", False, 0, 0, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.above = [0]  # of each region, the region around it; 0 is the page
        self.articles: set[int] = set()  # regions of article elements
        self.outer = [0]  # of each marked element, the marked one around it; 0 is none
        self.wraps: list[bool] = [True]  # whether a marked element may be a wrapper
        self.apart: list[bool] = [False]  # whether it is, or is in, one that can't be
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            now = self.open[-1]
            heading = any(x.name in HEADING for x in self.open[-3:])
            self.lines.append(Line(text, self.tags, self.linked, now.region, now.bound, now.furniture, heading, now.mark))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.imply_end(tag)
        self.tags += 1
        if tag in VOID:
            return
        around = self.open[-1]
        furniture, mark, region = around.furniture, around.mark, around.region
        if not furniture:
            furniture = tag in NEVER or tag == "header" and not around.bound or self.hidden(tag, attrs)
            if not furniture and self.marked(tag, attrs, around):
                self.outer.append(mark)
                self.wraps.append(tag != "form")
                self.apart.append(self.apart[mark] or self.named(attrs, ("class", "id"), APART) and tag != "article")
                mark = len(self.outer) - 1
            elif tag in PROSE:
                self.wraps[mark] = True
        if tag in CONTAINER:
            self.above.append(region)
            region = len(self.above) - 1
            if tag == "article":
                self.articles.add(region)
        bound = 2 if tag == "article" else max(around.bound, tag == "main")
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(Open(tag, furniture, bound, mark, region))

    def hidden(self, tag, attrs) -> bool:
        if tag in ("html", "body", "main"):
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES for name, value in attrs)

    def marked(self, tag, attrs, around) -> bool:
        """Whether the element may be furniture: a form, an article in an article, or by its names."""
        if tag in ("html", "body", "main"):
            return False
        if tag == "form" or tag == "article" and around.bound == 2:
            return True
        # the id of a section or a heading is an address for links, but says what can't be the article
        names = ("class",) if tag == "section" or tag in HEADING else ("class", "id")
        return tag != "article" and (self.named(attrs, names, FURNITURE) or tag == "section" and self.named(attrs, ("id",), APART))

    def named(self, attrs, names, pattern) -> bool:
        tokens = [t for name, value in attrs if value and name in names for t in value.split()]
        return any(pattern.search(t) and not MODIFIER.match(t) for t in tokens)

    def imply_end(self, tag):
        """Close the open element whose end tag may be left out before ``tag``."""
        ends, bounds = IMPLIED.get(tag, (None, None))
        if not ends:
            return
        last = lambda names: max((self.places[x][-1] for x in names if self.places.get(x)), default=0)
        at = last(ends)
        # no other block may stand between a paragraph and what ends it
        if at and at > last(bounds) and (ends != {"p"} or self.blocks[-1] == at):
            self.close_to(at)

    def close_to(self, size: int):
        while len(self.open) > size:
            name = self.open.pop().name
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        # an end without a start is void; one that skips open elements closes them
        if self.places.get(tag):
            self.close_to(self.places[tag][-1])

    def handle_data(self, data):
        self.parts.append(data)
        if self.places.get("a"):
            self.linked += len(data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with the kernel cut at three sigma and renormalised at the ends."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(values)]
    return full(values) / full(np.ones(len(values)))


def two_clusters(values: np.ndarray) -> float:
    """The threshold between two clusters of numbers: midway between their means, iterated."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        if not len(low) or not len(high):
            return float(values.min())
        now = (low.mean() + high.mean()) / 2
        if abs(now - at) < 1e-9:
            break
        at = float(now)
    return at


def judge_marks(lines: list[Line], reader: LineReader) -> None:
    """Lines in marked elements are furniture, unless the element holds most of the page's text or of its article.

    Comments, adverts and the like stay furniture, unless the page has no other text.
    """
    outer, apart = reader.outer, reader.apart
    open_lines = [x for x in lines if not x.furniture and not apart[x.mark]]
    if not any(x.plain for x in open_lines):
        open_lines, apart = [x for x in lines if not x.furniture], [False] * len(apart)
    # with text in an article, that is what counts: comments may be longer
    bounded = any(x.bound for x in open_lines)
    inside = [0] * len(outer)
    for x in open_lines:
        if x.bound or not bounded:
            inside[x.mark] += x.plain
    prose = list(reader.wraps)
    for mark in range(len(outer) - 1, 0, -1):
        inside[outer[mark]] += inside[mark]
        prose[outer[mark]] |= prose[mark]
    total = inside[0]
    plain = any(not x.mark and (x.bound or not bounded) and 2 * x.linked < len(x.text) for x in open_lines)
    # an element around one of these holds as much, so the innermost decides
    most = {mark for mark, n in enumerate(inside) if not apart[mark] and (mark == 0 or prose[mark] and 2 * n > total and (n == total or not bounded or not plain))}
    for x in lines:
        x.furniture = x.furniture or x.mark not in most


def dense_lines(lines: list[Line], free: list[bool], sigma: float) -> np.ndarray:
    """Which lines are in the upper of two clusters of smoothed text-to-tag ratios; ``free`` ones make the clusters."""
    ratio = np.array([x.plain / (x.tags + 1) for x in lines])
    smoothed = smooth(np.log1p(ratio), sigma)
    return smoothed >= two_clusters(smoothed[free])


def prose_regions(lines: list[Line], usable: list[bool]) -> set[int]:
    """Regions of plain prose: at least half of their lines (headings apart) are sentences, and few of their letters are links."""
    sentences, others = {}, {}
    for x, u in zip(lines, usable, strict=True):
        if u and not x.heading:
            is_prose = 4 * x.linked < len(x.text) and SENTENCE_END.search(x.text)
            kind = sentences if is_prose else others
            kind[x.region] = kind.get(x.region, 0) + 1
    return {r for r, n in sentences.items() if n >= others.get(r, 0)}


def content_regions(lines: list[Line], usable: list[bool], dense: np.ndarray, above: list[int], articles: set[int], bounded: bool) -> set[int]:
    """Regions with a dense line that isn't mostly links, and what belongs to them.

    Plain prose beside one of these, in the same element, belongs to it, but
    another article does not.

    Regions around one of these do (within an article or main element), and
    regions in them whose text is not mostly links: short paragraphs, tables,
    quotations. Lists of links and boxes apart from the content do not.
    """
    chosen = {x.region for x, u, d in zip(lines, usable, dense, strict=True) if u and d and 2 * x.linked < len(x.text)}
    beside = {above[r] for r in chosen if r}
    chosen |= {r for r in prose_regions(lines, usable) if r and r not in articles and above[r] in beside}
    plain, size, within = [0] * len(above), [0] * len(above), [False] * len(above)
    for x, u in zip(lines, usable, strict=True):
        if u:
            plain[x.region] += x.plain
            size[x.region] += len(x.text)
            within[x.region] = True
    for r in range(len(above) - 1, 0, -1):
        plain[above[r]] += plain[r]
        size[above[r]] += size[r]
    if bounded:
        for r in range(len(above) - 1, 0, -1):
            if r in chosen and within[above[r]]:
                chosen.add(above[r])
    core = set(chosen)
    for r in range(1, len(above)):  # a region's number is above that of the one around it
        # the page as a whole holds everything, so being in it says nothing
        if above[r] in core and (bounded or above[above[r]]) and 2 * plain[r] >= size[r]:
            core.add(r)
    return core


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of a page, its blocks joined by single spaces."""
    reader = LineReader()
    reader.feed(html or "")
    # a page may end within a tag, which isn't text
    cut = TAG_START.search(reader.rawdata, reader.rawdata.rfind(">") + 1)
    reader.rawdata = reader.rawdata[: cut.start()] if cut else reader.rawdata
    reader.close()
    reader.flush()
    lines = reader.lines
    judge_marks(lines, reader)
    # the innermost kind of element that holds text bounds the search: article, main, or the page
    bound = max((x.bound for x in lines if not x.furniture), default=0)
    usable = [not x.furniture and x.bound >= bound for x in lines]
    if not any(usable):
        return ""
    dense = dense_lines(lines, usable, sigma)
    chosen = content_regions(lines, usable, dense, reader.above, reader.articles, bound > 0)
    # beside an article, what is in the main element must be dense itself
    main = [not x.furniture and x.bound == 1 for x in lines] if bound == 2 else [False] * len(lines)
    beside = {x.region for x, m, d in zip(lines, main, dense, strict=True) if m and d and 2 * x.linked < len(x.text)}
    kept = [
        x.text
        for x, u, m in zip(lines, usable, main, strict=True)
        if u and (title(x) or x.region in chosen or not chosen) or m and (title(x) or x.region in beside)
    ]
    return " ".join(kept)


def title(line: Line) -> bool:
    """Whether a line is a heading of its own; a heading that is a link belongs to a list of other pages."""
    return line.heading and 2 * line.linked < len(line.text)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """Add ``text``: the main text of each page, from the whole of its HTML.

    Dropped are menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and reader comments.  Character references are
    decoded, white space inside a block becomes one space, blocks are joined in
    page order by one space.  Null, empty and textless pages give the empty
    text; malformed markup is read as far as it goes; very long pages and deeply
    nested or unclosed elements are read whole, in time proportional to their
    length; repeated rows give equal texts; an empty table gives an empty
    result; an existing ``text`` column is replaced.

    Dense lines (the upper cluster) select regions, in an article or main
    element as well: lists of links and boxes that hold no dense line are left
    out there.  Element names and roles say what is furniture; class names and
    ids do only for elements that don't hold most of the text.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, sigma) for h in pages], dtype=object)

    return pages.withColumn("text", extract.asNondeterministic()(F.col(html_col)))
