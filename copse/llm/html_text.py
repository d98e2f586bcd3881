"""Main text of HTML pages: parser events, text-to-tag ratios per line, smoothed and clustered.

The standard library's parser is fed as a stream; block tags cut its events
into lines, each with its text, its tags, its link text and its element. A
line's ratio of its characters outside links to its tags is smoothed along the
page with a Gaussian, and two-means on the logarithms of the smoothed ratios
parts content lines from the rest. Elements that can't hold the article (menus,
footers, asides, forms, dialogs, a header outside an article, by name or role)
and reader comments, adverts and notices by class or id are left out; of nested
articles the class is asked too, of others only whether it tells of comments. A
notice or the like stays where it has more than ``NEARLY`` of the page's content by
clustering and no article or main element has text beside it; comments never do.
Other class names that tell of boilerplate (search, share, related, side ...) are
a prior only: their lines aren't content, unless their element has more than
``MOST`` of the page's content by clustering.

The content region is the deepest element that holds ``MOST`` of the content
lines' characters, or an element around it (below the body) that adds nothing but
headings, paragraphs and list items; an article, or else a main element, with a good part of them
goes before it, with the articles beside it that are mostly text outside links.
There a line goes if it is mostly link text and below the clusters' threshold by
its smoothed ratio: menus and link lists inside the article go, a link among
paragraphs stays. In any other region a line that is not mostly link text stays if
it is content by its smoothed ratio, lies in a run of at most ``GAP`` lines between
content lines or in the same block as a content line, is a heading right before
one, or is a paragraph or list item in a run of at most ``GAP`` right after one
(not where the region is the whole body): so the clusters decide, and short
paragraphs among or after long ones stay.

Each step is linear in the page: elements are numbered as they open, an element's
descendants are a range of numbers, and sums over elements run once from the
last number to the first.

Defined cases: null is the empty page; a page without content has the empty
text; of regions that tie, the deeper and then the earlier is taken; a page of
one line is that line, unless it is left out; malformed nesting is closed by
the nearest open element of that name; very long pages are read whole; repeated
and null page_ids are kept row by row; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, MOST, NEARLY, GAP = 1.0, 0.6, 0.85, 3

# Roles of HTML elements.
SILENT = frozenset("script style head title noscript template iframe svg math canvas object audio video select option textarea button datalist".split())
APART = frozenset("nav footer aside form menu dialog fieldset".split())
CUTS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": CUTS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
MAIN = frozenset(["article", "main"])
PARAGRAPHS = frozenset("p li blockquote pre dt dd".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INLINE = frozenset("b i em strong span a font u".split())
FLOW = frozenset("p span b i em strong a u font li pre blockquote h1 h2 h3 h4 h5 h6 dt dd td th tr code small sub sup".split())
NEVER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|sidebar|footer|masthead|topbar|toolbar"
    r"|comments?|commentlist|replies|disqus|respond|newsletter|subscribe|signup|login)(?:$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|reply|disqus|respond)(?:$|[\s_-])", re.I)
PRIOR = re.compile(
    r"(?:^|[\s_-])(?:promo(?:tion)?|side|rail|widget|foot|header|discussion|share|sharing|social|related|recommended|search|form|results)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SPACES = re.compile(r"\s+")


class Lines(HTMLParser):
    """Parser events to lines: (text, tags, link characters, element, apart, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # name, element number, apart
        self.count: dict[str, int] = {}  # open elements by name
        self.names: list[str] = []
        self.parents: list[int] = []
        self.last: list[int] = []  # the last descendant of each element, once it is closed
        self.prior: list[bool] = []
        self.never: list[int] = []  # 1: left out by class or id, 2: comments
        self.silent = 0
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        self.text: list[str] = []
        self.tags = self.link = 0

    def cut(self):
        if self.text:
            text = SPACES.sub(" ", "".join(self.text)).strip()
            if text:
                name, number, apart = self.open[-1] if self.open else ("", -1, False)
                heading = any(self.count.get(h) for h in HEADINGS)
                self.lines.append((text, self.tags, min(self.link, len(text)), number, apart, heading))
                self.tags = 0
            self.text, self.link = [], 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag not in ("body", "article", "main"):
                return
            self._close_silent()
        if tag in CUTS:
            self.cut()
        self.tags += 1
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.pop()
        if tag in VOID:
            return
        apart = bool(self.open and self.open[-1][2])
        off, never, prior = self._marks(tag, attrs) if tag not in ("html", "body") else (False, 0, False)
        self.names.append(tag)
        self.parents.append(self.open[-1][1] if self.open else -1)
        self.last.append(-1)
        self.prior.append(prior)
        self.never.append(never)
        self.open.append((tag, len(self.names) - 1, apart or off))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in SILENT:
            self.silent += 1

    def _marks(self, tag, attrs) -> tuple[bool, int, bool]:
        """(left out by name or role, by class or id: 1 or, comments, 2, prior only)."""
        if tag in APART or tag == "header" and not any(self.count.get(x) for x in MAIN):
            return True, 0, False
        never, prior = 0, False
        whole = tag in MAIN and not self.count.get("article")
        for k, v in attrs:
            if k == "hidden" or v and (k == "role" and v.lower() in ROLES or k == "aria-hidden" and v == "true"):
                return True, 0, False
            if v and k in ("class", "id"):
                if COMMENTS.search(v) and tag != "main":
                    never = 2
                elif not whole and NEVER.search(v):
                    never = max(never, 1)
                prior = prior or tag != "main" and PRIOR.search(v) is not None
        return False, never, prior and not never

    def pop(self):
        tag, number, _ = self.open.pop()
        self.last[number] = len(self.names) - 1
        self.count[tag] -= 1
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)

    def _close_silent(self):
        while self.silent and self.open:
            self.pop()

    def handle_endtag(self, tag):
        if tag in CUTS and not self.silent:
            self.cut()
        self.tags += 1
        if not self.count.get(tag):
            return
        if tag in INLINE:
            for name, *_ in reversed(self.open):  # an inline end tag doesn't close the blocks around it
                if name == tag:
                    break
                if name in ("article", "main", "body", "table"):
                    return
        while self.open[-1][0] != tag:
            self.pop()
        self.pop()

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.count.get("a"):
                self.link += len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    k = int(3 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    w /= w.sum()
    return np.convolve(np.pad(ratios, k, mode="edge"), w, mode="valid")


def threshold(x: np.ndarray) -> float:
    """Midpoint of two-means on x."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(20):
        t = (lo + hi) / 2
        a, b = x[x <= t], x[x > t]
        if not len(b):
            return lo
        new = float(a.mean()), float(b.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None) -> str:
    p = Lines()
    if not html:
        return ""
    p.feed(html)
    p.close()
    p.cut()
    while p.open:
        p.pop()
    lines = p.lines
    if not lines:
        return ""
    size = np.array([len(t) for t, *_ in lines], float)
    plain = size - np.array([x[2] for x in lines])
    tags = np.array([max(1, x[1]) for x in lines], float)
    own = np.array([x[3] for x in lines])
    apart = np.array([x[4] for x in lines])

    def clustered(out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lines that may be content, those that are by the clusters, smoothed scores); lines left out count as without text."""
        fits = (2 * plain >= size) & ~out
        score = np.log1p(smoothed(np.where(out, 0.0, plain / tags)))
        content = (score >= threshold(score)) & fits
        return fits, content if content.any() else fits, score

    parents, last, n = p.parents, p.last, len(p.names)

    def within(chosen: list[int]) -> np.ndarray:
        """Lines inside any of the elements."""
        edge = np.zeros(n + 2, int)
        for e in chosen:
            edge[e] += 1
            edge[last[e] + 1] -= 1
        edge = np.cumsum(edge)
        edge[-1] = 0
        return edge[own] > 0

    def masses(kept: np.ndarray) -> list[float]:
        """Characters of kept lines in each element and its descendants; the page itself at the end."""
        out = np.zeros(n + 1)
        np.add.at(out, own, np.where(kept, size, 0.0))  # lines outside all elements (-1) go to the end
        out = out.tolist()
        for e in range(n - 1, -1, -1):
            out[parents[e]] += out[e]
        return out

    named_off = [e for e in range(n) if p.never[e]]
    if named_off:
        left_out = apart | within(named_off)
        if not (within([e for e in range(n) if p.names[e] in MAIN]) & ~left_out).any():  # no article beside them: one of them may be it
            content = clustered(apart | within([e for e in named_off if p.never[e] == 2]))[1]
            mass = masses(content)
            left_out = apart | within([e for e in named_off if p.never[e] == 2 or mass[e] <= NEARLY * mass[n]])
        apart = left_out
    fits, content, score = clustered(apart)
    mass = masses(content)
    off = within([e for e in range(n) if p.prior[e] and mass[e] <= MOST * mass[n]])  # a prior gives way to an element's content by clustering
    if off.any():
        fits, content, score = clustered(apart | off)
    if not content.any():
        return ""
    mass = masses(content)
    depth = [0] * n
    for e in range(n):
        depth[e] = depth[parents[e]] + 1 if parents[e] >= 0 else 1
    named = [e for e in range(n) if p.names[e] in MAIN and mass[e] >= (1 - MOST) * mass[n]]
    articles = [e for e in named if p.names[e] == "article"]
    if named:
        region = max(articles or named, key=lambda e: (mass[e], depth[e] if len(articles) < 2 else -depth[e], -e))
    else:
        deep = [e for e in range(n) if mass[e] >= MOST * mass[n] and p.names[e] not in FLOW]
        region = max(deep, key=lambda e: (depth[e], -e), default=-1)
        run = np.array([e >= 0 and p.names[e] in PARAGRAPHS or x[5] for e, x in zip(own.tolist(), lines, strict=True)])
        other = masses(fits & ~run)
        while region >= 0 and parents[region] >= 0 and p.names[parents[region]] not in ("html", "body") and other[parents[region]] == other[region]:
            region = parents[region]  # what it adds are headings, paragraphs and list items
    inside = np.ones(len(lines), bool) if region < 0 else (own >= region) & (own <= last[region])
    if named:
        if p.names[region] == "article":  # those beside it that are text, too
            text, every = masses(fits), masses(~apart)
            beside = [e for e in range(n) if p.names[e] == "article" and parents[e] == parents[region] and not p.prior[e] and text[e] >= MOST * every[e]]
            inside |= within(beside)
        stays = inside & ~apart & ((2 * plain >= size) | (score >= threshold(score)))
    else:
        block = list(range(n))  # the nearest element around each that isn't itself a piece of running text
        for e in range(n):
            if p.names[e] in FLOW:
                block[e] = block[parents[e]] if parents[e] >= 0 else n
        paragraph = run & inside & fits & (region >= 0 and p.names[region] not in ("html", "body"))
        stays = inside & fits & _joined(content & inside, np.array([*block, n])[own], [x[5] for x in lines], paragraph)
    return " ".join(t for (t, *_), ok in zip(lines, stays, strict=True) if ok)


def _joined(content: np.ndarray, block: np.ndarray, heading: list[bool], paragraph: np.ndarray) -> np.ndarray:
    """Content lines, and those in short gaps between them, in the same block, headings right before them, or short runs of paragraphs right after."""
    at = np.flatnonzero(content)
    k = np.searchsorted(at, np.arange(len(content)))
    before = np.where(k > 0, at[np.maximum(k - 1, 0)], -1)
    after = np.where(k < len(at), at[np.minimum(k, len(at) - 1)], -1)
    out = content | (before >= 0) & (after >= 0) & (after - before <= GAP + 1) | np.isin(block, block[at])
    run = False
    for i in range(len(content) - 1, -1, -1):
        run = content[i] or run and heading[i]
        out[i] |= run
    since = GAP + 1
    for i in range(len(content)):
        since = 0 if content[i] else since + 1 if paragraph[i] else GAP + 1
        out[i] |= since <= GAP
    return out


def _extract(batches):
    for b in batches:
        text = [main_text(h) for h in b["html"]]
        out = pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text})
        out["n_chars"] = [len(t) for t in text]
        yield out


def extract(pages: DataFrame, *, page_id="page_id", url="url", html="html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return p.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
