"""Main text of web pages, from parser events.

The standard library's parser streams a page as events, which are turned into lines: runs of
text between block-level tags, each with its characters and the tags it took to mark them up.
The text-to-tag ratio of the lines, smoothed by a Gaussian along the page, is split into two
clusters by the threshold that minimises their squared deviations; the upper cluster is
content. The content region is the least container around the largest article or main that
has the main headings and the lines of that cluster; without such an element, the least
container that has these. All its lines are returned, short ones too, except those in
elements that are never content: menus, page headers and footers, sidebars, notices, adverts,
forms, scripts, styles, hidden elements, reader comments (by tag, role, or names of class and
id), and list items and the like made of links alone, two or more in a row; paragraphs that
are links stay. A form or an element of such a name is kept when it wraps the content; an
article inside one is the main one only if none lies outside.

Character references are decoded, white space inside a line becomes one space, empty lines
vanish, lines are joined by two line feeds. Broken markup is read as far as the parser goes:
missing end tags are implied, stray ones ignored. A null or empty page, or one without
content, gives the empty text. Rows are neither dropped nor merged; an empty table gives an
empty table; columns other than those named are not read. A task holds one batch of pages.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playcohort.llm.common import map_rows, text_of

# Tags by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option "
    "svg iframe object canvas menu dialog math audio video datalist label fieldset".split()
)
CONTAINERS = frozenset("html body article main section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure "
    "figcaption header footer nav aside form fieldset address details summary hr hgroup".split()
)
#: A start tag of the key ends an open element of the values, up to the nearest container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = CONTAINERS | {"ul", "ol", "dl", "table", "blockquote", "nav", "aside", "header", "footer", "form", "figure"}
CELLS = {"td", "th", "tr"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs pagination pager toolbar sidebar "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login "
    "footer masthead copyright comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations widget search skip".split()
)
HEADERS = frozenset("header masthead".split())
#: Words that may stand beside a name in a compound like site-footer or comment-list.
BESIDE = frozenset(
    "site page main global top bottom left right upper lower primary secondary inner outer box bar list area wrap wrapper "
    "container block section panel group item items link links button buttons icon icons message text form thread "
    "posts post articles stories content body the js col row".split()
)
NAME_PART = re.compile(r"[a-z]+")
#: Names that say what an element is wherever they stand in a compound.
ANYWHERE = frozenset("ad ads advert adverts comment comments".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def named(given: dict[str, str], names: frozenset) -> bool:
    """Whether a class or id is one of ``names``, a compound that ends with one, or one of them and
    of words that may stand beside."""
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = NAME_PART.findall(name)
        found = names.intersection(parts)
        if found and (parts[-1] in names or found & ANYWHERE or set(parts) <= NAMES | HEADERS | BESIDE):
            return True
    return False


class PageLines(HTMLParser):
    """Collects the lines of a page.

    A line is (text, tags, characters inside links, container, excluded). Containers are
    numbered in page order; ``parents`` gives the one around each.

    Elements that are excluded by name, and forms, are doubtful until the page has ended: one
    that wraps the content is not excluded. They are numbered from 1 in page order, too.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parents = [-1]
        #: Containers that are an article or main.
        self.marks: list[int] = []
        #: Of each line: the doubtful element around it, and the block it is in.
        self.notes: list[tuple[int, str]] = []
        #: The doubtful element that an article or main is in, or is.
        self.mark_doubts: dict[int, int] = {}
        #: Of each doubtful element: the one around it, whether it is like a page header.
        self.doubts: list[tuple[int, bool]] = [(-1, False)]
        # Open elements: (tag, excluded, container, whether in an article, doubtful element, block),
        # and how many of each tag, so that looking for one that is not open costs nothing.
        self.open: list[tuple[str, bool, int, bool, int, str]] = []
        self.count: Counter = Counter()
        self.text: list[str] = []
        self.tags = self.linked = 0

    def around(self) -> tuple[bool, int, bool, int, str]:
        return self.open[-1][1:] if self.open else (False, 0, False, 0, "")

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            excluded, container, _, doubt, block = self.around()
            self.lines.append((line, self.tags, self.linked, container, excluded))
            self.notes.append((doubt, block))
            self.tags = 0
        self.text.clear()
        self.linked = 0

    def is_excluded(self, tag: str, given: dict[str, str], inside: bool) -> bool:
        if tag in NEVER and tag != "form" or tag == "header" and not inside:
            return True
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or HIDING.search(given.get("style", ""))
        return bool(hidden) or given.get("role") in ROLES

    def is_doubtful(self, tag: str, given: dict[str, str], inside: bool) -> tuple[bool, bool]:
        """Whether to exclude the element if it holds no content, and if it is like a page header."""
        if tag in ("html", "body", "main"):
            return False, False
        header = not inside and named(given, HEADERS)
        return tag == "form" or header or named(given, NAMES), header

    def main_mark(self, size: list[int]) -> int:
        """The largest article or main with text, of those inside the fewest doubtful elements; 0
        without any."""
        depth = {0: 0}
        for i in range(1, len(self.doubts)):
            depth[i] = depth[self.doubts[i][0]] + 1
        order = lambda c: (-depth[self.mark_doubts[c]], size[c])
        return max((c for c in self.marks if size[c]), key=order, default=0)

    def settle(self) -> None:
        """Decide the doubtful elements, and exclude the lines in those without the content.

        One holds the content when it has the largest article or main (without any: a main
        heading) and no fewer characters than there are outside of doubtful elements, or
        nearly all characters of a page where nothing else marks the content.
        """
        if len(self.doubts) == 1:
            return
        size = [0] * len(self.doubts)
        heading = [False] * len(self.doubts)
        inside = [0] * len(self.parents)
        for (text, _, linked, container, out), (doubt, block) in zip(self.lines, self.notes):
            if not out:
                n = max(0, len(text) - linked)
                size[doubt] += n
                heading[doubt] |= block == "h1"
                inside[container] += n
        plain = size[0]
        for i in range(len(size) - 1, 0, -1):
            around, header = self.doubts[i]
            size[around] += size[i]
            heading[i] &= not header
            heading[around] |= heading[i]
        for i in range(len(inside) - 1, 0, -1):
            inside[self.parents[i]] += inside[i]
        mark = self.main_mark(inside)
        holds = heading
        if mark and inside[mark]:
            holds = [False] * len(size)
            at = self.mark_doubts[mark]
            while at >= 0:
                holds[at] = True
                at = self.doubts[at][0]
        dropped = [False] * len(size)
        for i in range(1, len(size)):
            wraps = holds[i] and size[i] >= plain or not holds[0] and size[i] >= 0.95 * size[0] > 0
            dropped[i] = dropped[self.doubts[i][0]] or not wraps
        self.lines = [(*line[:4], line[4] or dropped[doubt]) for line, (doubt, _) in zip(self.lines, self.notes)]

    def pop_to(self, tags: set[str], scopes: frozenset | set) -> None:
        """End the innermost open element of ``tags`` unless a scope lies between."""
        if not any(self.count[tag] for tag in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                self.count.subtract(element[0] for element in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][0] in scopes:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            self.pop_to({"p"}, SCOPES | CELLS | {"li", "dd", "dt"})
        if tag in ENDS:
            self.pop_to(ENDS[tag], SCOPES - CELLS)
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        excluded, container, inside, doubt, block = self.around()
        if tag in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        self.count[tag] += 1
        given = {name: (value or "").lower() for name, value in attrs}
        excluded = excluded or self.is_excluded(tag, given, inside)
        if not excluded:
            doubtful, header = self.is_doubtful(tag, given, inside)
            if doubtful:
                self.doubts.append((doubt, header))
                doubt = len(self.doubts) - 1
        if tag in ("article", "main"):
            inside = True
            self.marks.append(container)
            self.mark_doubts[container] = doubt
        self.open.append((tag, excluded, container, inside, doubt, tag if tag in BLOCKS else block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # As browsers do, the slash counts for void elements only.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.pop_to({tag}, () if tag in SCOPES else SCOPES - {tag})

    def handle_data(self, data: str) -> None:
        # The text of scripts and styles is not even collected.
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if self.count["a"] > 0:
            self.linked += len("".join(data.split()))


def without_open_comment(html: str) -> str:
    """Cut at a comment that never ends, unless a script or style does after it."""
    at = html.rfind("<!--")
    open_end = at >= 0 and "-->" not in html[at:] and not re.search(r"(?i)</(script|style)", html[at:])
    return html[:at] if open_end else html


def page_lines(html: str) -> PageLines:
    html = without_open_comment(html)
    for source in (html, html.replace("<![", "&lt;![")):
        page = PageLines()
        try:
            page.feed(source)
            page.close()
        except AssertionError:  # the parser's answer to an unknown <![section
            continue
        page.end_line()
        page.settle()
        return page
    return PageLines()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Mask of the upper of two clusters with the least squared deviations; all if only one."""
    ordered = np.sort(values)
    if ordered[0] == ordered[-1]:
        return np.ones(len(values), dtype=bool)
    n = np.arange(1, len(ordered))
    sums, total = np.cumsum(ordered)[:-1], ordered.sum()
    between = sums**2 / n + (total - sums) ** 2 / (len(ordered) - n)
    between[ordered[1:] == ordered[:-1]] = -np.inf
    return values >= ordered[1 + int(np.argmax(between))]


def content_region(page: PageLines, sigma: float) -> int:
    """The container to return: the least one with all content lines and main headings and, where
    there is one, the largest article or main."""
    ratios = np.array([0.0 if out else len(t) / max(1, tags) for t, tags, _, _, out in page.lines])
    chosen = upper_cluster(smoothed(ratios, sigma))
    weight = [0] * len(page.parents)
    for text, _, linked, container, out in page.lines:
        if not out and linked < 0.9 * len(text.replace(" ", "")):
            weight[container] += max(0, len(text) - linked)
    # Children have higher numbers than the containers around them.
    for i in range(len(weight) - 1, 0, -1):
        weight[page.parents[i]] += weight[i]
    best = page.main_mark(weight) or None
    if best is None:
        # Smoothing lifts what stands next to the text; a line must be like it by itself, too.
        chosen = chosen & upper_cluster(ratios)
    for is_content, (text, _, linked, container, out), (_, block) in zip(chosen, page.lines, page.notes):
        if out or linked >= 0.9 * len(text.replace(" ", "")) or not (block == "h1" or is_content):
            continue
        best = container if best is None else shared(page.parents, best, container)
    return best or 0


def shared(parents: list[int], a: int, b: int) -> int:
    """The least container around two."""
    while a != b:
        if a > b:
            a = parents[a]
        else:
            b = parents[b]
    return a


def main_text(html: str | None, sigma: float = 1.0) -> str:
    page = page_lines(html) if html else None
    if page is None or not page.lines:
        return ""
    region = content_region(page, sigma)
    inside = [False] * len(page.parents)
    for i in range(len(inside)):
        inside[i] = i == region or i > 0 and inside[page.parents[i]]
    kept = [(line, block) for line, (_, block) in zip(page.lines, page.notes) if inside[line[3]] and not line[4]]
    is_link = [block != "p" and linked >= 0.9 * len(text.replace(" ", "")) for (text, _, linked, _, _), block in kept]
    out = []
    for i, (line, _) in enumerate(kept):
        # Two or more links in a row are a list of links; a single one may be a sentence.
        beside = i > 0 and is_link[i - 1] or i + 1 < len(kept) and is_link[i + 1]
        if not (is_link[i] and beside):
            out.append(line[0])
    return "\n\n".join(out)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points), one row per page."""
    given = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_of(html_col).alias("html"))
    kept = [f"k{i} {given.schema[i].dataType.simpleString()}" for i in range(len(keep))]

    def rows(columns: dict[str, list]) -> dict[str, list]:
        texts = [main_text(html, sigma) for html in columns["html"]]
        return {**columns, "text": texts, "n_chars": [len(text) for text in texts]}

    out = map_rows(given, rows, ", ".join([*kept, "text string", "n_chars bigint"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
