"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming parser gives events; block elements cut the page into
lines. Each line has a text-to-tag ratio (characters of text over tags, text inside links
counted as tags); ratios are smoothed with a Gaussian over neighbouring lines, and a
threshold on them (THRESHOLD standard deviations) parts dense lines from the rest. The
dense lines are clustered by the element that holds them: an element's weight is what its
dense lines stand above the threshold, and the content region is the innermost element
that keeps SHARE of the page's weight. Further elements of its kind join it if their own
weight is RIVAL of the region's, so a page of several articles keeps all. Of a region all
lines stay, among them titles (also one right before it) and short paragraphs, but lines of
links under the threshold; one paragraph of links between two dense ones stays. Names of
elements that may mean an article's part or another (share, search, privacy) cut nothing:
lines there weigh less and stay if they are dense without their neighbours' help. A page that marks its article gives the mark as a prior: lines
there weigh PRIOR times as much, a region inside the mark grows to it, and dense lines of
other marked parts stay. Parts that are no article by their element, role or class are left out before.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.5
SIGMA = 1.0
#: Part of the dense lines' weight that the content region keeps.
SHARE = 0.7
#: Part of the region's weight from which another element of its kind is content too.
RIVAL = 0.2
#: How much more a line inside an element that marks the article weighs.
PRIOR = 8.0
#: What part of the mean ratio of dense lines a line reaches, without smoothing, where names leave doubt.
OWN = 0.3
#: Lines between two dense ones, or before the first, that go with them on a page without containers.
GAP = 3

_DROP = frozenset("head title script style noscript template iframe object embed svg canvas nav footer aside form button select textarea input option dialog menu audio video map".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html body head title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption template noscript script style".split())
_MARK = frozenset(("article", "main"))
_CONTAINERS = frozenset("html body main article section div td table tbody tr center details li ul ol dl dd blockquote".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class and id names that mark parts that are no article, and those that mark the article.
_OTHER = re.compile(
    r"(?:^|[_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|topbar|toolbar|menu\w*|breadcrumbs?|sidebar\w*|aside|footer\w*|masthead|cookies?\w*|consent|gdpr|notices?|notifications?|alert\w*|popup\w*|modal\w*|newsletter\w*|subscri\w*|signup|login|paywall|comments?|commentlist|commenters?|disqus|repl(?:y|ies)|respond|related\w*|recommend\w*|social\w*|widgets?|pagination|pager|outbrain|taboola|search-?(?:bar|box|form|field|input))(?=$|[_-])"
)
#: Words that such parts and parts of an article both bear: lines there must be as dense as others by themselves.
_DOUBT = re.compile(r"(?:^|[_-])(?:form|overlay|privacy|rail|search|searches|share|shares|sharing|side|skip|tags)(?=$|[_-])")
_OTHER_ARTICLE = re.compile(r"^(?:ad|advert\w*|sponsor\w*|promo\w*|comments?|repl(?:y|ies)|related\w*|recommend\w*|teaser\w*)(?=$|[_-])")
_CONTENT = re.compile(r"^(?:content|main|article|post|entry|story|(?:main|page|article|post|entry|story|body)-(?:content|body|text|main)|content-(?:body|main))$")
_STATES = ("has-", "with-", "no-", "is-", "js-", "without-", "not-")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names(value: str) -> list[str]:
    """Class or id names, camel humps as hyphens, in lower case, without those that only tell a state."""
    return [n for n in _HUMP.sub("-", value).lower().replace("__", "-").split() if not n.startswith(_STATES)]


class _Lines(HTMLParser):
    """Collects lines: text, tags, characters in links, whether an article is marked and whether names leave doubt there, and the elements that hold them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # element, whether it drops what it holds
        self.dropping = 0
        self.doubts: list[int] = []  # depths of elements whose names leave doubt
        self.links = 0
        self.marks: list[int] = []  # depths of elements that mark an article
        self.path: list[int] = []  # numbers of the open elements
        self.kinds: list[str] = []
        self.marking: set[int] = set()  # numbers of the elements that mark an article
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.lines: list[tuple[str, int, int, bool, bool, tuple[int, ...]]] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, bool(self.marks), bool(self.doubts), tuple(self.path)))
        self.parts.clear()
        self.tags = self.linked = 0

    def _other(self, tag: str, attrs) -> bool:
        if tag in _DROP:
            return True
        if tag == "header":
            return not self.marks
        if tag in ("html", "body"):
            return False
        words = _OTHER_ARTICLE if tag in _MARK else _OTHER
        for k, v in attrs:
            if k == "hidden" or k == "aria-hidden" and v == "true":
                return True
            if v and (k in ("class", "id") and any(words.search(n) for n in _names(v)) or k == "role" and v.lower() in _ROLES):
                return True
        return False

    def _content(self, tag: str, attrs) -> bool:
        """Whether a plain element says that it holds the content; inside a marked one that tells nothing new."""
        if self.marks or tag not in ("div", "section", "td"):
            return False
        return any(v and (k in ("class", "id") and any(_CONTENT.match(n) for n in _names(v)) or k == "role" and v == "main" or k == "itemprop" and v == "articleBody") for k, v in attrs)

    def _doubtful(self, tag: str, attrs) -> bool:
        if tag in _MARK or tag in ("html", "body"):
            return False
        return any(v and k in ("class", "id") and any(_DOUBT.search(n) for n in _names(v)) for k, v in attrs)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self.links += 1
            return
        other = self._other(tag, attrs)
        doubt = tag in _BLOCK and self._doubtful(tag, attrs)
        if tag not in _BLOCK and not other:
            return
        if tag in _MARK and not other:
            # an article does not stand in a menu or page header: those were left open
            while self.open and self.open[-1][0] in ("nav", "header", "ul", "li") and self.dropping:
                self._pop()
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self._pop()
        self.open.append((tag, other))
        self.path.append(len(self.kinds))
        self.kinds.append(tag)
        self.dropping += other
        if doubt:
            self.doubts.append(len(self.open))
        if not self.dropping and (tag == "article" or tag == "main" and not self.marks or self._content(tag, attrs)):
            self.marks.append(len(self.open))
            self.marking.add(self.path[-1])

    def _pop(self):
        tag, other = self.open.pop()
        self.path.pop()
        self.dropping -= other
        for depths in (self.marks, self.doubts):
            while depths and depths[-1] > len(self.open):
                depths.pop()

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self._pop()
                break
            if self.open[k][0] in _MARK and tag not in _MARK and tag not in ("body", "html"):
                break  # a stray end tag closes nothing beyond its article

    def handle_data(self, data):
        if not self.dropping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; at the ends the kernel is renormalised."""
    r = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    num = np.convolve(ratio, kernel)[r : r + len(ratio)]
    return num / np.convolve(np.ones(len(ratio)), kernel)[r : r + len(ratio)]


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by newlines; null or no text: empty."""
    if not html:
        return ""
    lines = _Lines()
    try:
        lines.feed(html)
        lines.close()
    except AssertionError:  # a marked section that the parser does not know
        lines = _Lines()
        lines.feed(html.replace("<![", "&lt;!["))
        lines.close()
    lines.flush()
    if not lines.lines:
        return ""
    texts, tags, linked, marked, doubt, paths = zip(*lines.lines, strict=True)
    n = np.array([len(t) for t in texts], float)
    linked = np.minimum(n, np.array(linked, float))
    ratio = (n - linked) / np.maximum(1, tags)
    keep = content_lines(ratio, smoothed(ratio), linked > 0.5 * n, np.array(marked), np.array(doubt), paths, lines.kinds, lines.marking)
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def content_lines(ratio: np.ndarray, soft: np.ndarray, links: np.ndarray, marked: np.ndarray, doubt: np.ndarray, paths, kinds: list[str], marking: set[int]) -> np.ndarray:
    """Which lines are content, by their ratios, the smoothed ones, the elements that hold them (outermost first), the kinds of those and which mark an article."""
    least = THRESHOLD * soft.std()
    dense = (soft >= least) & ~links
    if doubt.any():
        sure = ratio[dense & ~doubt]
        dense &= ~doubt | (ratio >= max(least, OWN * (sure.mean() if len(sure) else 0.0)))
    weight = np.where(dense, soft - least + 1e-9, 0.0) * np.where(marked, PRIOR, 1.0) / np.where(doubt, PRIOR, 1.0)
    held: dict[int, float] = {}
    for w, path in zip(weight.tolist(), paths, strict=True):
        if w:
            for e in path:
                held[e] = held.get(e, 0.0) + w
    total = weight.sum()
    if not total:
        return np.zeros(len(soft), bool)
    # from the outermost element inwards, as long as one element keeps its part of the weight; lines that no
    # element holds, or none that is a container, are a region of their own
    region = -1
    inner: dict[int, set[int]] = {}
    for path in paths:
        for up, e in zip((-1, *path), path):
            inner.setdefault(up, set()).add(e)
    while True:
        best = max((e for e in inner.get(region, ()) if kinds[e] in _CONTAINERS), key=lambda e: held.get(e, 0.0), default=None)
        if best is None or held.get(best, 0.0) < SHARE * total:
            break
        region = best
    around = next((path[: path.index(region) + 1] for path in paths if region in path), ())
    region = next((e for e in around if e in marking and kinds[e] != "main"), region)  # the whole of the article it lies in
    regions = {region}
    if region < 0 or kinds[region] in ("body", "html", "main"):
        # no single element: those of one kind that weigh enough, if they hold nearly all of it
        kids = {e: held.get(e, 0.0) for e in inner.get(region, ()) if kinds[e] in _CONTAINERS}
        most = max(kids.values(), default=0.0)
        good = {e for e, w in kids.items() if w >= RIVAL * most > 0}
        if good and sum(kids[e] for e in good) >= SHARE * total:
            regions = good
    inside = np.array([region < 0 and region in regions or any(e in regions for e in path) for path in paths])
    if not (marked & inside).any() and (region < 0 or kinds[region] in ("body", "html")) and region in regions:
        # a page without any container: dense lines and what stands between them
        good = np.flatnonzero(dense)
        near = np.zeros(len(soft), bool)
        near[good] = True
        for a, b in zip(good[:-1], good[1:], strict=True):
            near[a : b + 1] |= b - a <= GAP
        if good[0] and good[0] <= GAP:
            near[: good[0]] = True  # titles stand before the first dense line
        inside &= near
    elif inside.any():
        first = int(np.flatnonzero(inside)[0])
        while first and "h1" in {kinds[e] for e in paths[first - 1]}:  # the title right before the region
            first -= 1
            inside[first] = True
    # a paragraph of links between two dense ones of its own element
    among = np.zeros(len(soft), bool)
    for i in np.flatnonzero(links[1:-1] & dense[:-2] & dense[2:]) + 1:
        among[i] = bool(paths[i]) and kinds[paths[i][-1]] == "p" and all(paths[j][:-1] == paths[i][:-1] for j in (i - 1, i + 1))
    return inside & (dense | among | ~links & ~doubt) | marked & dense


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with a column out (replaced if it is there): the main text of every row; never null.

    A null or empty html gives an empty text, repeated rows equal texts. The whole html is
    read, whatever its length, and no other column is.
    """
    return pages.withColumn(out, F.pandas_udf(lambda h: h.map(extract).astype(object) if len(h) else pd.Series([], dtype=object), "string")(F.col(html_col)))


def op4_html(spark, sf_dir: str) -> DataFrame:
    got = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


QUERIES = {"op4_html": op4_html}

#: The same for pages that mark their article and part its blocks by <p> and <h1>, as the table here does.
ORACLE_SQL = {
    "op4_html": r"""with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as art from pages),
b as (select page_id, url, list_filter(list_transform(regexp_split_to_array(replace(art, '<br>', ' '), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') as blocks from a)
select page_id, url, coalesce(array_to_string(blocks, chr(10)), '') as text, length(coalesce(array_to_string(blocks, chr(10)), '')) as n_chars from b"""
}
