"""Numbers from free text and web pages, with the class of metric that the words around them suggest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.spans import with_matches
from ..session import stored
from .pages import closed, joined, slices, whole_references

NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"



class Windows(NamedTuple):
    """How numbers are taken from a text: characters on both sides that class a percentage and a number, and those within
    which a number needs an alias (None: none needed); a fixed label of percentages; the years that aren't numbers; whether texts
    such as 2.2025 are versions; how many characters of a text are read (None: all)."""

    percent: int = 100
    number: int = 200
    alias: int | None = 500
    percent_label: str | None = None
    years: tuple[int, int] = (1900, 2050)
    versions: bool = True
    most: int | None = None


LABELS = ("incidence", "prevalence", "mortality", "survival", "rate", "value")


def mentions(text: str, words: list[str]):
    c = F.lower(F.col(text))
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def datapoints(docs: DataFrame, id_col: str, text: str, classes: list[tuple[str, list[str]]], aliases: list[str], windows: Windows = Windows()) -> DataFrame:
    """id, pos, kind, label, found: percentages from 0 to 100, and plausible numbers near a keyword, and an alias where the windows ask for one.

    Texts without keyword, digit or (if asked for) alias are dropped in the scan. All of it runs in the JVM, without a shuffle.
    """
    words = [w for _, ws in classes for w in ws]
    wanted = mentions(text, words) & F.col(text).rlike("[0-9]")
    if windows.alias is not None:
        wanted = mentions(text, aliases) & wanted
    read = F.col(text) if windows.most is None else F.left(text, F.lit(windows.most))
    some = docs.where(wanted).select(F.col(id_col).alias("id"), read.alias("t"))
    return _found(some, "percent", r"\d+(?:\.\d+)?\s*%", classes, aliases, windows).unionByName(_found(some, "number", NUMBER, classes, aliases, windows))


def _found(some: DataFrame, kind: str, pattern: str, classes: list[tuple[str, list[str]]], aliases: list[str], windows: Windows) -> DataFrame:
    words = [w for _, ws in classes for w in ws]
    each = with_matches(some, "ms", "t", pattern, F.lit(True)).select("id", "t", F.posexplode("ms").alias("pos", "m")).select("id", "t", F.col("pos").cast("long").alias("pos"), "m.start", "m.end", "m.hit")
    first = lambda n: F.greatest(F.col("start") - n, F.lit(0))
    around = lambda n: F.lower(F.substring("t", first(n) + 1, F.col("end") + n - first(n)))
    placed, label = each.withColumn("near", around(windows.percent if kind == "percent" else windows.number)), X.first_class("near", classes)
    if kind == "percent":
        number = F.regexp_extract("hit", r"^[\d.]+", 0)
        placed = placed.where(number.try_cast("double").between(0, 100)).withColumn("hit", F.concat(number, F.lit("%")))
        label = F.lit(windows.percent_label) if windows.percent_label else label
    else:
        placed = placed.where(X.plausible_number("hit", windows.years, windows.versions) & mentions("near", words))
        if windows.alias is not None:
            placed = placed.withColumn("wide", around(windows.alias)).where(mentions("wide", aliases))
    return placed.select("id", "pos", F.lit(kind).alias("kind"), label.alias("label"), F.col("hit").alias("found"))


def summarise(points: DataFrame, most: int = 15) -> DataFrame:
    """id, summary: different numbers by class and place, the first `most`, as `v (class); ..`; a single one without its class.

    Percentages come before numbers at equal class. Unclassed numbers under 10 are left out. Every id's points are few: they come from one text.
    """
    rank = reduce(lambda w, kv: w.when(F.col("label") == kv[1], kv[0]), enumerate(LABELS), F.when(F.lit(False), 0)).otherwise(len(LABELS))
    plain = F.regexp_replace("found", "[, %]", "")
    rows = points.withColumn("plain", plain).where(~((F.col("label") == "value") & (plain.try_cast("double") < 10)))
    order = F.struct(rank.alias("r"), F.when(F.col("kind") == "percent", 0).otherwise(1).alias("k"), F.col("pos"), F.col("found"), F.col("label"))
    first = rows.groupBy("id", "plain").agg(F.min(order).alias("o"))
    listed = first.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("os"))
    part = lambda o: F.concat(o["found"], F.lit(" ("), o["label"], F.lit(")"))
    text = F.array_join(F.transform(F.slice("os", 1, most), part), "; ")
    return listed.select("id", F.when(F.size("os") == 1, F.col("os")[0]["found"]).otherwise(text).alias("summary"))


class Blocks(HTMLParser):
    """Text blocks and table rows of a page; style, script, nav, footer, header and aside are left out.

    A row of a table carries the table's caption and the heading before it as context.
    """

    DROP = {"style", "script", "nav", "footer", "header", "aside", "noscript"}
    TAGS = {"p", "li", "td", "th", "div", "section", "h1", "h2", "h3", "h4"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.dropped: list[str] = []
        self.heading = self.caption = ""
        self.cells: list[str] | None = None

    def parse_html_declaration(self, i):
        """Declarations and marked sections end at the next `>`, comments at their own end; one that isn't closed takes the rest."""
        if self.rawdata.startswith("<!--", i):
            end = self.rawdata.find("-->", i + 4)
            return end + 3 if end >= 0 else len(self.rawdata)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def flush(self, tag: str = "") -> None:
        text = joined(self.text)
        self.text = []
        if not text:
            return
        if self.cells is not None and tag != "caption":
            self.cells.append(text)
        elif tag == "caption":
            self.caption = text
        else:
            self.blocks.append(text)
            if tag in ("h1", "h2", "h3", "h4", "p"):
                self.heading = text

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.dropped.append(tag)
        if self.dropped:
            return
        if tag == "table":
            self.flush()
            self.caption = ""
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in self.TAGS or tag == "caption":
            self.flush()

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
            return
        if tag == "tr" and self.cells is not None:
            self.flush()
            if self.cells:
                self.rows.append((" ".join(self.cells), f"{self.caption} {self.heading}"))
            self.cells = None
        elif tag in self.TAGS or tag == "caption":
            self.flush(tag)

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)

    def close(self):
        super().close()
        self.flush()


def page_blocks(pages: DataFrame, id_col: str = "page_id", html: str = "html", least: int = 30) -> DataFrame:
    """id, pos, kind, text, context: a page's blocks of more than `least` characters, and its table rows. Parsing HTML needs Python; it runs over Arrow batches."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out: list[list] = [[], [], [], [], []]
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = Blocks()
                parser.feed(closed(whole_references(page or "")))
                parser.close()
                found = [("block", b, "") for b in parser.blocks if len(b) > least] + [("row", r, c) for r, c in parser.rows]
                for pos, (what, text, context) in enumerate(found):
                    for column, x in zip(out, (key, pos, what, text, context)):
                        column.append(x)
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["id", "pos", "kind", "text", "context"])

    return pages.select(id_col, html).mapInArrow(run, f"id {kind}, pos long, kind string, text string, context string")


def page_datapoints(pages: DataFrame, classes: list[tuple[str, list[str]]], aliases: list[str], id_col: str = "page_id") -> DataFrame:
    """datapoints() of every block and row of a page, keyed by page and block."""
    blocks = page_blocks(pages, id_col)
    # a row counts if its own words or its caption and heading name the subject
    subject = F.when((F.col("kind") == "row") & ~mentions("text", aliases) & mentions("context", aliases), F.concat("text", F.lit(" "), F.col("context"))).otherwise(F.col("text"))
    keyed = blocks.select(F.struct(F.col("id").alias("page"), F.col("pos").alias("block")).alias("at"), subject.alias("text"))
    return datapoints(keyed, "at", "text", classes, aliases).select(F.col("id.page").alias("page_id"), F.col("id.block").alias("block"), "pos", "kind", "label", "found")


def with_extractor(pages: DataFrame, patterns: list[tuple[str, str]], url: str = "url", default: str = "page") -> DataFrame:
    """Adds extractor: the name of the first pattern that the URL contains, in lower case. Pages of a kind are read by rules of their own."""
    u = F.lower(F.coalesce(F.col(url), F.lit("")))
    return pages.withColumn("extractor", F.coalesce(*[F.when(F.contains(u, F.lit(p)), F.lit(name)) for p, name in patterns], F.lit(default)))


def polite(urls: DataFrame, fetch, url: str = "url", pause: float = 1.0, n: int = 12) -> DataFrame:
    """url, body, error: fetches pages with a pause between requests to one host.

    Rows are dealt out by host, so each host is one task's; fetch(url) -> str runs on the executors.
    """
    import time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            bodies, errors = [], []
            for u in batch.column(0).to_pylist():
                host = re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", u or "", flags=re.S)
                time.sleep(max(0.0, last.get(host, 0.0) + pause - time.monotonic()))
                last[host] = time.monotonic()
                try:
                    bodies.append(fetch(u))
                    errors.append(None)
                except Exception as e:  # a source that fails is logged, not raised
                    bodies.append(None)
                    errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=["url", "body", "error"])

    host = F.regexp_extract(url, HOST, 1)
    return urls.select(F.col(url).alias("url")).repartition(n, host).mapInArrow(run, "url string, body string, error string")


HOST = "^[a-z]+://([^/?#]*)"
SITE = r"^[a-z]+://(?:[^/?#]*[.])?([^./?#]+[.][^./?#]+)"


def roots(pages: DataFrame, within: str = HOST, id_col: str = "page_id") -> DataFrame:
    """url of one page of every host, or other part of the URL: that of the least id. Where a crawl starts."""
    return pages.groupBy(F.regexp_extract("url", within, 1).alias("site")).agg(F.min(F.struct(id_col, "url")).alias("p")).select("p.url")


def crawl(pages: DataFrame, links: DataFrame, start: DataFrame, depth: int = 4, within: str = HOST, held_only: bool = True, enough: DataFrame | None = None) -> DataFrame:
    """url, depth: what start reaches over links (src, dst) within a host, or another part of the URL, each at its least depth.

    held_only leaves out URLs that pages don't hold. Links of the pages in enough (url), which have given what was looked
    for, aren't followed. One join a level; the URLs seen so far are joined out, so that cycles end. Every frontier is
    stored, so a level's plan doesn't hold those before it.
    """
    host = lambda c: F.regexp_extract(c, within, 1)
    seen = frontier = start.select("url", F.lit(0).cast("long").alias("depth")).distinct()
    known = pages.select("url").distinct()
    links = links.select("src", "dst")
    if enough is not None:
        links = links.join(enough.select(F.col("url").alias("src")).distinct(), "src", "left_anti")
    for level in range(1, depth + 1):
        step = frontier.join(links, frontier["url"] == links["src"]).where(host("dst") == host("src")).select(F.col("dst").alias("url")).distinct()
        step = step.join(seen, "url", "left_anti")
        if held_only:
            step = step.join(known, "url", "left_semi")
        frontier = stored(step.select("url", F.lit(level).cast("long").alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
