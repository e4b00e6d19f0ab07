"""Main text of web pages: text-to-tag ratios of parser events, smoothed and clustered.

The standard library's parser streams start tags, end tags and text. Each run of
text between two block borders is a line with a count of the tags in it. A line's
ratio is its characters (those of links count little) to its tags, times the
evidence of the structure around it: nothing in what can never be content (scripts,
menus, footers, sidebars, forms, notices, adverts, reader comments), little under a
doubtful class name, and little beside a page's articles. The logarithms of the
ratios are smoothed by a Gaussian kernel among the lines of one frame (an article, or
the page around articles), and clustered with one cluster held at zero. The lines of
the other clusters select the regions:

- an article that holds such a line is content, all of it that has any value;
- beside articles, such lines are content;
- on a page without articles content is what lies from the first such line to the
  last, and what stands beside them in the region that holds them all.

Nothing else decides: a line is in the text only by its smoothed value.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIGMA = 1.0
RADIUS = 3
#: What a link's character counts; what structure leaves of a line's ratio under a doubtful class name, and beside the page's articles.
LINK, DOUBT, BESIDE = 0.1, 0.3, 0.05

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never content.
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe svg object canvas dialog menu".split())
RAW = frozenset(("script", "style"))
#: Those of them that stand within a line of text without ending it.
WITHIN = frozenset("script style noscript template button select option textarea input iframe svg object canvas".split()) | INLINE
ROOTS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that mark what is not content, whatever the element.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors cookie cookies consent gdpr
    sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus replies respond
    newsletter skip""".split()
)
#: Words that do so on containers (div, section, ul and others), and make a paragraph or heading doubtful.
SOFT_MARKS = frozenset(
    """promo promotion banner notice notices alert popup modal overlay subscribe subscription signup aside widget widgets discussion
    share sharing social related recommended recommendations toolbar search login""".split()
)
#: Words that may stand beside a mark in one name without changing what it says.
PLAIN_WORDS = frozenset(
    """list links link box bar block wrap wrapper container content section area slot button buttons post posts article articles item items unit left right top bottom
    site page main inner outer text message group panel icon icons header head body title id js col row module component small large primary secondary global
    print more and the in on for to of us me this read next prev previous""".split()
)
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption address".split()) | INLINE
#: The same outside an article only: an article has headers of its own.
OUTER_MARKS = frozenset("header masthead topbar".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKED = re.compile(r"<!\[[^>]*>")


def marks(value: str) -> set[str]:
    """Words of a class or id: parted at hyphens, underscores, digits and capitals."""
    return {w.lower() for w in _TOKENS.findall(value)}


class Lines(HTMLParser):
    """Collects (text, tags, link characters, region, evidence) for each block of text; evidence is 0 in what can never be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, float]] = []
        self.open: list[tuple[str, float, int, tuple | None]] = []  # tag, evidence and region before it, and the line that it stands within
        self.evidence = 1.0
        self.links = 0
        self.region = 0
        self.parents = [0]  # of each region
        self.roots = [-1]  # the outermost article or main that holds the region; -1 if none does
        self.tops = {0}  # the page itself and its body
        self.rooted = 0  # open articles and mains
        self.text: list[str] = []
        self.tags = 0
        self.link_chars = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, self.link_chars, self.region, self.evidence))
            self.text = []
        self.tags = self.link_chars = 0

    def _leaves(self, tag: str, attrs) -> float:
        """What the element leaves of the evidence: 1, DOUBT or 0."""
        if tag in NEVER:
            return 0.0
        if tag == "header":
            return float(self.rooted > 0)
        if tag in ("html", "body", "main"):
            return 1.0
        out = 1.0
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return 0.0
            if not value:
                continue
            if name == "role" and value.lower() in ROLES:
                return 0.0
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return 0.0
            if name in ("class", "id"):
                for one in value.split():
                    out = min(out, self._named(tag, marks(one)))
        return out

    def _named(self, tag: str, words: set[str]) -> float:
        strong, soft = words & MARKS, words & SOFT_MARKS
        if words & OUTER_MARKS and not self.rooted:
            return 0.0
        if not strong and not soft:
            return 1.0
        if tag == "article" and not words & {"comment", "comments", "ad", "ads", "related", "promo"}:
            return 1.0
        if words - MARKS - SOFT_MARKS - PLAIN_WORDS:  # a name that says something else as well
            return DOUBT
        return 0.0 if strong or tag not in TEXT_TAGS else DOUBT

    def _pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, evidence, region, around = self.open.pop()
            if around:
                self.flush()
                self.text, self.tags, self.link_chars = around
            self.evidence = evidence
            if tag == "a":
                self.links -= 1
            if tag in ROOTS:
                self.rooted -= 1
            self.region = region

    def _imply(self, tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        """End an open element that the next start tag ends by implication."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self._pop_to(k)
                return
            if self.open[k][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag not in WITHIN:
            self.flush()
            if tag == "li":
                self._imply(("li",), ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                self._imply(("dd", "dt"), ("dl",))
            elif tag in ("td", "th"):
                self._imply(("td", "th"), ("tr", "table"))
            elif tag == "tr":
                self._imply(("tr",), ("table",))
            elif tag == "option":
                self._imply(("option",), ("select",))
            else:
                self._imply(("p",), ("div", "article", "section", "main", "td", "li", "body", "blockquote", "aside", "nav", "footer", "header", "form"))
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        leaves = self._leaves(tag, attrs)
        around = None
        if tag in WITHIN:
            if not leaves:  # its text is a line apart from the one around it
                around, self.text, self.tags, self.link_chars = (self.text, self.tags, self.link_chars), [], 1, 0
            else:
                leaves = 1.0
        self.open.append((tag, self.evidence, self.region, around))
        self.evidence *= leaves
        if tag == "a":
            self.links += 1
        if tag in ("article", "main", "div", "section", "td", "body"):
            above = self.roots[self.region]
            self.parents.append(self.region)
            self.roots.append(above if above >= 0 else len(self.roots) if tag in ROOTS else -1)
            self.region = len(self.roots) - 1
            if tag == "body":
                self.tops.add(self.region)
        self.rooted += tag in ROOTS

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # the slash has no meaning in HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in WITHIN:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop_to(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] in RAW:
            return
        self.text.append(data)
        if self.links:
            self.link_chars += len(data)


def kernel(sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def smooth(ratio: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Gaussian smoothing among neighbours of one frame; where others or none stand, the kernel is renormalised."""
    n = len(ratio)
    total, weight = np.zeros(n), np.zeros(n)
    for j, w in zip(range(-RADIUS, RADIUS + 1), kernel()):
        if abs(j) < n:
            to, of = slice(max(0, -j), n - max(0, j)), slice(max(0, j), n - max(0, -j))
            same = frame[to] == frame[of]
            total[to] += w * ratio[of] * same
            weight[to] += w * same
    return total / weight


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters of values, one held at zero: half the mean of the other (from the greatest value down)."""
    c = float(values.max())
    for _ in range(50):
        mean = float(values[values >= c / 2].mean())
        if mean == c:
            break
        c = mean
    return c / 2


def density(chars: np.ndarray, tags: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Characters for each tag of a line; those within links count less."""
    return np.maximum(chars - (1 - LINK) * links, 0) / np.maximum(tags, 1)


def select(lines: list[tuple[str, int, int, int, float]], roots: list[int], parents: list[int], tops: set[int]) -> list[int]:
    """The numbers of the lines that are content."""
    root = np.array([roots[x[3]] for x in lines])
    chars, tags, links = (np.array(v, float) for v in ([len(x[0]) for x in lines], [x[1] for x in lines], [x[2] for x in lines]))
    evidence = np.array([x[4] for x in lines])
    if (evidence[root >= 0] > 0).any():
        evidence = np.where(root >= 0, evidence, BESIDE * evidence)
    ratio = np.log1p(evidence * density(chars, tags, links))
    value = smooth(ratio, np.where(evidence > 0, root, -2))
    high = (value >= threshold(value)) & (value > 0)
    held = set(root[high & (root >= 0)].tolist())
    if held:
        return np.flatnonzero((np.isin(root, list(held)) & (value > 0)) | (high & (root < 0))).tolist()
    mine = np.flatnonzero(high).tolist()
    if not mine:
        return []
    holder = lines[mine[0]][3]
    for r in {lines[k][3] for k in mine}:
        while r != holder:  # a region's number is larger than its parent's
            r, holder = (parents[r], holder) if r > holder else (r, parents[holder])
    within = {holder} if holder not in tops else set()
    for r, parent in enumerate(parents):
        if r and parent in within:
            within.add(r)
    beside = lambda k, end: 0 <= k < len(lines) and value[k] > 0 and (lines[k][3] in within or lines[k][3] == lines[end][3])
    first, last = mine[0], mine[-1]
    while beside(first - 1, first):
        first -= 1  # a heading has few characters and stands before the text
    while beside(last + 1, last):
        last += 1
    return [k for k in range(first, last + 1) if value[k] > 0]


def extract(html: str) -> str:
    """The main text: blocks joined by two line feeds. Empty where a page has none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_MARKED.sub(" ", html) if "<![" in html else html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    return "\n\n".join(parser.lines[k][0] for k in select(parser.lines, parser.roots, parser.parents, parser.tops))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages (page_id, url, html).

    A null or empty page has an empty text. Repeated rows give equal rows, whatever
    their ids. A very long page is read whole, alone in its batch; nothing is dropped or
    cut by length. A line whose value is just the threshold is in. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    common.small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in common.sized(batches, "html", 4 << 20):
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    html = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return html.mapInArrow(run, "page_id long, url string, text string, n_chars long")
