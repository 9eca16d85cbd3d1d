"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its 4-word shingles. Sets of one size band, and those of the next that may still reach it, use
the same partition of the feature domain: n1 groups of n2 cells. Two sets of Jaccard similarity c or more differ in k
features at most, so with n1 * (k2 + 1) > k some group holds at most k2 of them, and the n2 - k2 other cells of that
group agree: enumerating the subsets of n2 - k2 cells gives both sets one equal signature. Every candidate pair is
verified on the whole sets. Where a group of equal signatures holds many sets that are nearly similar, its pairs are cut
down by the rarest shingles first.

Signatures of empty cells would pair strangers. `slack` more groups make sure that some agreeing group has none empty,
unless both sets have more than slack such groups; only those sets also get a prefix of their features as signatures.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, masked, materialise, text_map, with_row_key
from .graph import components

PART = 1 << 20
BASE = 0xD1342543DE82EF97
_byte = np.random.Generator(np.random.PCG64(1)).integers(0, 2**64, 256, dtype=np.uint64)
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_blank = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Where so many documents or fewer are candidates, their row keys (8 bytes each) are broadcast to find the texts.
MOST_BROADCAST = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes: differences of a running polynomial over the bytes, with a random number for
    each byte value. Words are hashed where they lie, about a megabyte at once; data begin and end with a blank.
    """
    blank = np.flatnonzero(_blank[data])
    begins, hashes, low = [], [], 0
    while low < len(data) - 1:
        high = blank[min(max(np.searchsorted(blank, low + PART, "right") - 1, np.searchsorted(blank, low + 1)), len(blank) - 1)]
        part = data[low : high + 1]
        empty = _blank[part]
        begin, end = np.flatnonzero(empty[:-1] & ~empty[1:]) + 1, np.flatnonzero(~empty[:-1] & empty[1:]) + 1
        up, down = powers(max(len(part), PART) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte[part] * up[: len(part)], out=run[1:])
        begins.append(begin + low)
        hashes.append(mix((run[end] - run[begin]) * down[begin]))
        low = int(high)
    return (np.concatenate(begins), np.concatenate(hashes)) if begins else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_sets(texts: list[str | None], width: int = 4) -> list[np.ndarray]:
    """Per text its sorted distinct shingles as 64-bit hashes; with fewer words the whole sequence is one shingle."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin, flat = word_hashes(np.frombuffer(b" " + b" ".join(raw).translate(_lower) + b" ", np.uint8))
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    first = np.searchsorted(begin, np.cumsum(size) - size + 1)
    n = len(flat)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mix(flat[i : n - width + 1 + i] + np.uint64(i))
    rolled = mix(rolled)
    out = []
    for at, to in zip(first.tolist(), [*first[1:].tolist(), n]):
        k = to - at
        if k >= width:
            out.append(np.unique(rolled[at : to - width + 1]))
        else:
            short = mix(flat[at:to] + np.arange(k, dtype=np.uint64) + np.uint64(1000 * k))
            out.append(mix(short.sum(keepdims=True)) if k else np.zeros(0, np.uint64))
    return out


def print_of(s: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed integer."""
    return int(mix(mix(s).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


@lru_cache(maxsize=4096)
def bands(percent: int) -> list[tuple[int, int]]:
    """Size bands: each reaches 1/c² times its least size."""
    out, low = [], 1
    while low < 1 << 40:
        high = low * 10_000 // (percent * percent)
        out.append((low, high))
        low = high + 1
    return out


def band_of(size: int, percent: int) -> int:
    table = bands(percent)
    lo, hi = 0, len(table) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if table[mid][1] < size else (lo, mid)
    return lo


class Scheme:
    """The partition that pairs of a band, and of it and the next, use."""

    def __init__(self, band: int, percent: int, n2: int, k2: int):
        self.band, self.k = band, (100 - percent) * bands(percent)[band][1] // percent
        least = math.ceil((self.k + 1) / (k2 + 1))
        self.slack = 1 + least // 6
        self.n1, self.n2, self.cells = least + self.slack, n2, (least + self.slack) * n2
        self.subsets = list(itertools.combinations(range(n2), n2 - k2))
        self.salt = np.uint64(0x9E3779B97F4A7C15 * (band + 1) % 2**64)

    def cells_of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = mix(s ^ self.salt)
        return value, (value % np.uint64(self.cells)).astype(np.int64)

    def needed(self, s: np.ndarray) -> int:
        """Similar sets agree in slack + 1 groups; those of them that have an empty subset may give no signature."""
        held = np.bincount(self.cells_of(s)[1], minlength=self.cells).reshape(self.n1, self.n2)
        bare = np.zeros(self.n1, bool)
        for subset in self.subsets:
            bare |= held[:, subset].sum(1) == 0
        return max(1, self.slack + 1 - int(bare.sum()))

    def signatures(self, s: np.ndarray, percent: int) -> np.ndarray:
        value, cell = self.cells_of(s)
        total = np.zeros(self.cells, np.uint64)
        np.add.at(total, cell, mix(value))
        held = np.bincount(cell, minlength=self.cells).reshape(self.n1, self.n2)
        total = total.reshape(self.n1, self.n2)
        bare = np.zeros(self.n1, bool)
        parts = []
        for i, subset in enumerate(self.subsets):
            full = held[:, subset].sum(1) > 0
            bare |= ~full
            group = np.arange(self.n1, dtype=np.uint64) * np.uint64(len(self.subsets)) + np.uint64(i)
            parts.append(mix(mix(total[:, subset].sum(1, dtype=np.uint64) + self.salt) + group)[full])
        if bare.sum() > self.slack:
            prefix = s[: len(s) - -(-percent * len(s) // 100) + 1]
            parts.append(mix(mix(prefix) + self.salt + np.uint64(1)))
        return np.concatenate(parts)


@lru_cache(maxsize=4096)
def scheme(band: int, percent: int, n2: int, k2: int) -> Scheme:
    return Scheme(band, percent, n2, k2)


def schemes(s: np.ndarray, percent: int, n2: int, k2: int) -> list[Scheme]:
    """Those of a set: of its band, and of the one below if similar sets may lie there."""
    if not len(s):
        return []
    band = band_of(len(s), percent)
    below = [band - 1] if band and percent * len(s) <= 100 * bands(percent)[band - 1][1] else []
    return [x for x in (scheme(b, percent, n2, k2) for b in [band, *below]) if x.k]


def needed(s: np.ndarray, percent: int, n2: int, k2: int) -> int:
    return min((x.needed(s) for x in schemes(s, percent, n2, k2)), default=1)


def signatures(s: np.ndarray, percent: int, n2: int, k2: int) -> np.ndarray:
    """All signatures of a set. Bands in which similar sets are equal sets have none: equal sets share a fingerprint."""
    made = [x.signatures(s, percent) for x in schemes(s, percent, n2, k2)]
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def fingerprints(rows: DataFrame, text: str, percent: int, width: int, n2: int, k2: int) -> DataFrame:
    """_row, fp (null for the empty set), n_shingles, need: how many signatures it shares with any similar set, at least."""

    def make(kept, texts):
        sets = shingle_sets(texts, width)
        return [kept["_row"], [print_of(s) if len(s) else None for s in sets], [len(s) for s in sets], [needed(s, percent, n2, k2) for s in sets]]

    return text_map(rows, ["_row"], text, "_row long, fp long, n_shingles long, need int", make, PART)


def signature_rows(rows: DataFrame, text: str, percent: int, width: int, n2: int, k2: int) -> DataFrame:
    """sig, fp: the signatures of every set; equal sets of a chunk give theirs once."""

    def make(_, texts):
        found = {print_of(s): s for s in shingle_sets(texts, width) if len(s)}
        sigs = [signatures(s, percent, n2, k2) for s in found.values()]
        n = np.array([len(x) for x in sigs], np.int64)
        every = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
        return [pa.array(every.view(np.int64)), pa.array(np.repeat(np.array(list(found), np.int64), n))]

    return text_map(rows, [], text, "sig long, fp long", make, PART)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. texts: fp, text."""
    left, right = (texts.select(F.col("fp").alias(x), F.col("_text").alias(f"t{x}")) for x in "ab")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, hub = None, None
        for batch in batches:
            a, ta, tb = (batch.column(i).to_pylist() for i in (0, 2, 3))
            keep: list[bool] = []
            for low, high in chunks([len(t) + 64 for t in tb], PART):
                for i, other in zip(range(low, high), shingle_sets(tb[low:high], width)):
                    if a[i] != last:  # pairs come sorted by a
                        last, hub = a[i], shingle_sets([ta[i]], width)[0]
                    same = len(np.intersect1d(hub, other, assume_unique=True))
                    keep.append(100 * same >= percent * (len(hub) + len(other) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def rare_pairs(nodes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """a, b: pairs of nodes (fp, rep, n, label) of different labels that may be similar, by prefixes in the order of rarity.

    Similar sets share one of the n - ceil(c * n) + 1 rarest shingles of each. Near copies that differ from all others
    in more than that many have only shingles of their own there, and meet nobody. What two sets share lies in what each has left from
    their first common shingle on, which bounds their similarity by numbers alone.
    """
    mine = texts.join(nodes.select("fp", "rep"), "fp").select("rep", "_text")

    def make(rows, found):
        # 40 bits of a shingle will do: shingles that share them are taken for one, which only lets more pairs through
        sets = [np.unique(s >> np.uint64(24)) for s in shingle_sets(found, width)]
        n = np.array([len(s) for s in sets])
        return [pa.array(np.repeat(rows["rep"].to_numpy(zero_copy_only=False), n)), pa.array(np.concatenate(sets).view(np.int64))]

    each = text_map(mine, ["rep"], "_text", "rep long, shingle long", make, PART)
    each = each.withColumn("df", F.count("*").over(Window.partitionBy("shingle")))
    alone = each.where(F.col("df") == 1).groupBy("rep").agg(F.count("*").alias("alone"))
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    ranked = each.where(F.col("df") > 1).withColumn("nth", nth).join(nodes.join(alone, "rep", "left"), "rep")
    ranked = ranked.withColumn("rank", F.col("nth") + F.coalesce("alone", F.lit(0)))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    by_shingle = Window.partitionBy("shingle")
    mixed = prefix.withColumn("low", F.min("label").over(by_shingle)).withColumn("high", F.max("label").over(by_shingle)).where(F.col("low") < F.col("high"))
    # what is left of a set from this shingle on: at the first that two sets share, all that they share lies there
    left = F.col("n") - F.col("rank") + 1
    mixed = materialise(mixed.select("shingle", "fp", "n", "label", left.alias("met")), "prefixes")
    x, y = mixed.toDF("shingle", "a", "na", "la", "ma"), mixed.toDF("shingle", "b", "nb", "lb", "mb")
    most = F.least("ma", "mb")
    may = 100 * most >= percent * (F.col("na") + F.col("nb") - most)
    return x.join(y, "shingle").where((F.col("la") < F.col("lb")) & may).select("a", "b").distinct()


def similar_components(rows: DataFrame, text: str = "text", percent: int = 85, width: int = 4, n2: int = 2, k2: int = 1) -> DataFrame:
    """_row, n_shingles, component (the least _row that links reach, itself included). rows have a unique _row.

    Pairs are drawn in two rounds, so that a group of near copies needs few: first every member of a signature's group
    with the member that shares most groups. Then the members of groups that still hold several components are joined
    by rare_pairs(), which loses no similar pair among them. Pairs that neither round tries are in one component already.
    """
    base = materialise(fingerprints(rows, text, percent, width, n2, k2), "prints")
    reps = base.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("_row").alias("rep"), F.first("n_shingles").alias("n"), F.first("need").alias("need"))
    by_sig = Window.partitionBy("sig")
    sigs = signature_rows(rows, text, percent, width, n2, k2).withColumn("least", F.min("fp").over(by_sig)).withColumn("most", F.max("fp").over(by_sig))
    shared = materialise(sigs.where(F.col("least") < F.col("most")).select("sig", "fp").distinct(), "shared")
    members = shared.groupBy("fp").agg(F.count("*").alias("degree"))
    members = materialise(members.join(reps, "fp"), "members")
    n = members.count()
    wanted = members.select(F.col("rep").alias("_row"), "fp")
    found = rows.select("_row", F.col(text).alias("_text")).join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, "_row")
    texts = materialise(found.select("fp", "_text"), "texts")
    known = shared.join(members.select("fp", "degree", "n", "rep", "need"), "fp")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    hub = F.min(F.struct(-F.col("degree"), F.col("fp"), F.col("n"))).over(by_sig)
    first = known.withColumn("hub", hub).where((F.col("hub.fp") != F.col("fp")) & alike(F.col("hub.n"), F.col("n")))
    tried = materialise(first.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).distinct(), "tried")
    links = materialise(verified(tried, texts, percent, width), "links")
    ids = members.select("fp", "rep")
    as_rows = lambda e: e.join(ids.toDF("a", "ra"), "a").join(ids.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    labels = components(as_rows(links))
    labelled = known.join(labels, known["rep"] == labels["node"], "left").select("sig", "fp", "rep", "n", "need", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.withColumn("low", F.min("label").over(by_sig)).withColumn("high", F.max("label").over(by_sig)).where(F.col("low") < F.col("high"))
    mixed = mixed.groupBy("fp", "rep", "n", "label").agg(F.count("*").alias("met"), F.first("need").alias("need"))
    mixed = materialise(mixed.where(F.col("met") >= F.col("need")).select("fp", "rep", "n", "label"), "mixed")
    done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialise(verified(rare_pairs(mixed, texts, percent, width).join(done, ["a", "b"], "left_anti"), texts, percent, width), "links")
    if not more.isEmpty():
        labels = components(as_rows(links.unionByName(more)))
    of_print = reps.join(labels, reps["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component"))
    of_print = materialise(of_print, "components")  # so that the join below has two shuffled sides, and a print of very many copies can be split
    return base.join(of_print, "fp", "left").select("_row", "n_shingles", F.coalesce("component", "_row").alias("component"))


def join_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least id among the rows that links reach.

    Null texts have the empty set, and are linked with nothing. Repeated rows are rows of one component; very long texts give
    their whole sets; an empty table gives an empty result; other columns of docs aren't read.
    """
    rows = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    made = similar_components(rows, "_text", **how)
    ids = rows.select("_row", "doc_id")
    named = made.join(ids, "_row").join(ids.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that of the least id; of rows that repeat it the first by with_row_key().

    Texts without words stay. Very long texts are compared whole, an empty table stays empty, columns keep their names.
    """
    hidden, names = masked(docs)
    at = dict(zip(docs.columns, names))
    rows = with_row_key(hidden, at[doc_id])
    made = similar_components(rows, at[text], **how)
    keep = made.where(F.col("_row") == F.col("component")).select("_row")
    return rows.join(keep, "_row", "left_semi").select(*names).toDF(*docs.columns)
