"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Parser events cut a page into lines (runs of text between block tags). A line's ratio is its characters over its
tags. A threshold on the smoothed ratios clusters the lines into content and rest. The clusters decide three things:

* the region: the deepest element that holds nine tenths of the content lines' characters;
* the region's edges: lines before its first and behind its last content line stay only where their container holds
  content too (in an article element: where they aren't links);
* elements with an ambiguous name (`related`, `alert`): they stay if most of their text is content and not links.

Tag, role and class lists are an aid: what they mark as boilerplate takes no part in the choice of the region and is
left out of it, unless it wraps the content.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import others, text_map

BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
SILENT = frozenset("script style head title noscript template iframe object svg math canvas audio video select button textarea datalist input".split())
#: Elements that are boilerplate by their tag.
MARKED = frozenset("nav header footer aside menu dialog".split())
#: Elements that pass their lines on to the element around them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre a b i u s em strong small span font code q cite mark sub sup abbr time label".split())
_firm = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adslot|adbox|sponsor\w*|promo\w*|sidebar\w*|side-bar|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|cookies?\w*|consent|gdpr|notices?|notification\w*|"
    r"comments?|commentlist|comment-\w+|disqus\w*|replies|respond|subscribe|newsletter|signup|login|popup|modal|pagination|pager|toolbar|skip-link)(?:$|[^a-z])"
)
_maybe = re.compile(r"(?:^|[^a-z])(?:aside|banner|alert|disclaimer|discussion|related|recommend\w*|share|sharing|social\w*|overlay|widget|copyright)(?:$|[^a-z])")
_comment = re.compile(r"(?:^|\s)comment")
_role = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element that opens ends an open one of these kinds, within the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO, MAYBE, WRAPPER, FIRM = range(4)
_comment_end = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)


def mark(tag: str, given: dict[str, str]) -> int:
    """How far an element is boilerplate by its tag, role and names."""
    named = f"{given.get('class', '')} {given.get('id', '')}".lower().replace("_", "-")
    if tag in ("html", "body"):
        return NO
    if tag in ("article", "main"):
        return FIRM if _comment.search(named) else NO
    if tag in MARKED or given.get("role", "").lower() in _role:
        return FIRM
    if tag in ("form", "fieldset"):
        return WRAPPER
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return NO
    return WRAPPER if _firm.search(named) else MAYBE if _maybe.search(named) else NO


class Lines(HTMLParser):
    """Collects lines: [text pieces, tags, element, linked characters]. Elements are listed by tag, parent, silence and mark.

    A page is fed at once, so what isn't closed at its end (a comment, a declaration, a tag) is consumed and gives no
    text; declarations and marked sections end at the next `>`. Every event costs amortised constant time.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.silent, self.marks = [""], [-1], [False], [NO]
        self.open: list[int] = [0]
        self.blocks: list[int] = []  # depths of the open block elements
        self.count: Counter[str] = Counter()  # open elements by tag
        self.lines: list[list] = []
        self.fresh = True

    def to(self, end: int) -> int:
        return end if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        found = _comment_end.match(self.rawdata, i)
        return found.end() if found else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.to(self.rawdata.find(">", i) + 1 or -1)

    def parse_pi(self, i):
        return self.to(self.rawdata.find(">", i) + 1 or -1)

    def parse_starttag(self, i):
        return self.to(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self.to(super().parse_endtag(i))

    def line(self) -> list:
        if self.fresh or self.silent[self.lines[-1][2]] != self.silent[self.open[-1]]:
            self.lines.append([[], 0, self.open[-1], 0])
            self.fresh = False
        return self.lines[-1]

    def close_to(self, depth: int) -> None:
        self.fresh |= bool(self.blocks) and self.blocks[-1] >= depth
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()
        self.count.subtract(self.tags[e] for e in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.fresh = True
            while tag != "br" and self.blocks:
                name = self.tags[self.open[self.blocks[-1]]]
                if name != "p" and name not in ENDS.get(tag, ()):
                    break
                self.close_to(self.blocks[-1])
        self.line()[1] += 1
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        silent = self.silent[self.open[-1]] or tag in SILENT or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.silent.append(silent)
        self.marks.append(mark(tag, given))
        self.count[tag] += 1
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(len(self.tags) - 1)
        if tag in BLOCK or silent or self.marks[-1]:
            self.fresh = True

    def handle_endtag(self, tag):
        if self.count[tag] > 0:
            depth = len(self.open) - 1
            while self.tags[self.open[depth]] != tag:
                depth -= 1
            self.line()[1] += 1
            self.fresh |= bool(self.marks[self.open[depth]])
            self.close_to(depth)
        elif tag in BLOCK:
            self.fresh = True

    def handle_data(self, data):
        if data.strip():
            self.line()[0].append(data)
            if self.count["a"] > 0:
                self.lines[-1][3] += len(data)
        elif self.lines and not self.fresh:
            self.lines[-1][0].append(data)


def smoothed(ratio: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian smoothing over the lines, with standard deviation of half the radius."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-2.0 * (at / radius) ** 2)
    return np.convolve(np.pad(ratio, radius), kernel / kernel.sum(), "valid")


def in_content(ratio: np.ndarray) -> np.ndarray:
    """Which lines the threshold puts into the content cluster: one standard deviation of the smoothed ratios."""
    smooth = smoothed(ratio)
    return smooth >= min(smooth.std(), smooth.max())


def sums_inside(page: Lines, values: np.ndarray, elements: np.ndarray) -> np.ndarray:
    """For each element the sum of the values of the lines inside it. Parents have lower numbers than their children."""
    total = np.bincount(elements, values, len(page.tags)).tolist()
    for e in range(len(total) - 1, 0, -1):
        total[page.parents[e]] += total[e]
    return np.array(total)


def handed_down(page: Lines, own: list) -> list:
    """For each element its own value, or else that of the element around it."""
    for e in range(1, len(own)):
        own[e] = own[e] or own[page.parents[e]]
    return own


def main_text(html: str | None) -> str:
    """The page's main text; empty for null, empty or text-free pages."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    found = [(" ".join("".join(p).split()), tags, e, linked) for p, tags, e, linked in page.lines if not page.silent[e]]
    found = [x for x in found if x[0]]
    if not found:
        return ""
    texts = [x[0] for x in found]
    tags, of, linked = (np.array([x[i] for x in found]) for i in (1, 2, 3))
    size = np.array([len(t) for t in texts], float)
    content = in_content(size / np.maximum(1, tags))
    # a wrapper's mark is void if it holds an article or nine tenths of the text, and an ambiguous one if most of its text is content without links
    every, dense = sums_inside(page, size, of), sums_inside(page, size * (content & (2 * linked <= size)), of)
    holds = [t in ("article", "main") and m == NO for t, m in zip(page.tags, page.marks)]
    for e in range(len(holds) - 1, 0, -1):
        holds[page.parents[e]] |= holds[e]
    void = lambda e, m: m == WRAPPER and (holds[e] or 10 * every[e] >= 9 * size.sum()) or m == MAYBE and (holds[e] or 2 * dense[e] >= every[e])
    marked = np.array(handed_down(page, [m != NO and not void(e, m) for e, m in enumerate(page.marks)]))[of]
    if marked.all():
        return ""
    if not (content & ~marked).any():
        content = ~marked
    content &= ~marked
    inside = sums_inside(page, size * content, of)
    named = [e for e in np.flatnonzero(2 * inside >= inside[0]) if page.tags[e] in ("article", "main")]
    region = int(max(named or [e for e in np.flatnonzero(10 * inside >= 9 * inside[0]) if page.tags[e] not in PARTS], default=0))
    within = [False] * len(page.tags)
    within[region] = True
    here = np.flatnonzero(np.array(handed_down(page, within))[of] & ~marked)
    box = list(range(len(page.tags)))
    for e in range(1, len(box)):
        box[e] = box[page.parents[e]] if page.tags[e] in PARTS else e
    good = np.flatnonzero(content[here])
    boxes = {box[e] for e in of[here[good]]}
    stays = (lambda i: 2 * linked[i] <= size[i]) if named else (lambda i: box[of[i]] in boxes)
    return " ".join(texts[i] for n, i in enumerate(here) if good[0] <= n <= good[-1] or stays(i))


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep columns, text, n_chars (code points) of every whole page.

    Null, empty and text-free pages give an empty text. Repeated rows and ids are extracted row by row, so ties need no
    rule; an empty table gives an empty result. Very long pages are parsed whole, in linear time. Columns of pages named text or
    n_chars give way to those made here.
    """
    keep = others(keep, "text", "n_chars")

    def make(rows, texts):
        made = [main_text(t) for t in texts]
        return [*[rows[c] for c in keep], made, [len(t) for t in made]]

    kinds = dict(pages.dtypes)
    return text_map(pages, keep, html, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long", make)
