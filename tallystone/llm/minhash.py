"""MinHash near-duplicates: minima of universal hashes, bands, signatures compared, components by large and small stars.

A document is the set of its word shingles (four words, as the query's contract wants). `hashes` functions
a * x + b modulo 2**64 each give the least value of a set, of which 32 bits are kept. Bands of these minima are the
buckets; two sets of similarity s share one of them with probability 1 - (1 - s**w)**bands: with 128 minima in 32 bands of
four a pair at 0.8 is missed once in 2 * 10**7, one at 0.9 once in 10**15. Candidates whose signatures agree in fewer than
`least_agreeing()` places are dropped, which a pair at the threshold meets once in 10**9. The rest are confirmed on whole sets.

A bucket of very many near copies gives few pairs: first each member with the bucket's hub (the member that shares most
buckets). Where members of different components still share buckets, the pairs among these are found by their rarest
shingles (jaccard.rare_pairs(), an exact prefix filter), so that no pair is dropped for a bucket's size.

Null and empty texts, and those without words, have the empty set and are linked with nothing. Equal sets are one set from
the start, so repeated rows and very many copies cost no pairs. Very long texts are hashed whole; a text is one row of one
task. Ties between hubs go to the smaller fingerprint. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import masked, materialise, text_map, with_row_key
from .graph import components
from .jaccard import MOST_BROADCAST, PART, print_of, rare_pairs, shingle_sets, verified

HASHES, BANDS = 128, 32


@lru_cache
def family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal hash functions."""
    a, b = np.random.Generator(np.random.PCG64(12)).integers(0, 2**64, (2, hashes), dtype=np.uint64)
    return a | np.uint64(1), b


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """The signatures of non-empty sets: len(sets) x hashes numbers of 32 bits."""
    out = np.zeros((len(sets), hashes), np.uint32)
    if sets:
        size = np.array([len(s) for s in sets])
        flat, begin = np.concatenate(sets), np.cumsum(size) - size
        value = np.empty_like(flat)
        for i, (a, b) in enumerate(zip(*family(hashes))):
            np.multiply(flat, a, out=value)
            value += b
            out[:, i] = np.minimum.reduceat(value, begin) >> np.uint64(32)
    return out


@lru_cache
def least_agreeing(percent: int, hashes: int, missed: float = 1e-9) -> int:
    """The most places in which signatures may be asked to agree, if a pair of the threshold is to be lost no more often than `missed`."""
    p, tail = percent / 100, 0.0
    for k in range(hashes + 1):
        tail += comb(hashes, k) * p**k * (1 - p) ** (hashes - k)
        if tail > missed:
            return k
    return hashes


def signatures(rows: DataFrame, text: str, width: int, hashes: int) -> DataFrame:
    """_row, fp (null for the empty set), n_shingles, sig (4 bytes a minimum) of every row, in one pass over the texts."""

    def make(kept, texts):
        sets = shingle_sets(texts, width)
        sigs = iter(minima([s for s in sets if len(s)], hashes))
        return [kept["_row"], [print_of(s) if len(s) else None for s in sets], [len(s) for s in sets], [next(sigs).tobytes() if len(s) else None for s in sets]]

    return text_map(rows, ["_row"], text, "_row long, fp long, n_shingles long, sig binary", make, PART)


def alike(pairs: DataFrame, sigs: DataFrame, hashes: int, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in `least` places or more. sigs: fp, sig."""
    of = lambda x: sigs.select(F.col("fp").alias(x), F.col("sig").alias(f"s{x}"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, hashes) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def shared_buckets(sets: DataFrame, hashes: int, bands: int) -> DataFrame:
    """key, fp, n, size: the buckets of each set (fp, n, sig) that hold another set as well. Sizes are counted by partial sums and joined back."""
    width = 4 * (hashes // bands)
    keys = F.expr(f"explode(transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width}))))")
    rows = sets.select(keys.alias("key"), "fp", "n")
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key").select("key", "fp", "n", "size")


def hub_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """a, b: each member of a bucket with its hub, the member whose buckets hold most sets."""
    known = shared.join(shared.groupBy("fp").agg(F.sum("size").alias("met")), "fp")
    hubs = known.groupBy("key").agg(F.min(F.struct(-F.col("met"), F.col("fp"), F.col("n"))).alias("hub"))
    pairs = shared.join(hubs, "key").where(F.col("hub.fp") != F.col("fp"))
    near = pairs.where(100 * F.least("hub.n", "n") >= percent * F.greatest("hub.n", "n"))
    return near.select(F.col("hub.fp").alias("a"), F.col("fp").alias("b")).distinct()


def near_components(rows: DataFrame, text: str = "text", percent: int = 80, width: int = 4, hashes: int = HASHES, bands: int = BANDS) -> DataFrame:
    """_row, n_shingles, component (the least _row that links reach, itself included). rows have a unique _row."""
    base = materialise(signatures(rows, text, width, hashes), "minima")
    reps = base.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("_row").alias("rep"))
    sets = base.join(reps.select(F.col("rep").alias("_row")), "_row").select("fp", F.col("_row").alias("rep"), F.col("n_shingles").alias("n"), "sig")
    sets = materialise(sets, "sets")
    shared = materialise(shared_buckets(sets, hashes, bands), "shared")
    members = materialise(sets.join(shared.select("fp").distinct(), "fp"), "members")
    wanted = members.select(F.col("rep").alias("_row"), "fp")
    found = rows.select("_row", F.col(text).alias("_text")).join(F.broadcast(wanted) if members.count() <= MOST_BROADCAST else wanted, "_row")
    texts = materialise(found.select("fp", "_text"), "texts")
    least = least_agreeing(percent, hashes)
    confirmed = lambda pairs: verified(materialise(alike(pairs, members.select("fp", "sig"), hashes, least), "alike"), texts, percent, width)
    tried = materialise(hub_pairs(shared, percent), "tried")
    links = materialise(confirmed(tried), "links")
    ids = members.select("fp", "rep")
    as_rows = lambda e: e.join(ids.toDF("a", "ra"), "a").join(ids.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    labels = components(as_rows(links))
    labelled = members.join(labels, members["rep"] == labels["node"], "left").select("fp", "rep", "n", F.coalesce("label", "rep").alias("label"))
    labelled = materialise(labelled, "labelled")
    seen = shared.join(labelled.select("fp", "label"), "fp")
    split = seen.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high"))
    mixed = materialise(labelled.join(seen.join(split, "key").select("fp").distinct(), "fp"), "mixed")
    done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialise(confirmed(rare_pairs(mixed, texts, percent, width).join(done, ["a", "b"], "left_anti")), "links")
    if not more.isEmpty():
        labels = components(as_rows(links.unionByName(more)))
    of_print = reps.join(labels, reps["rep"] == labels["node"], "left").select("fp", F.coalesce("label", "rep").alias("component"))
    of_print = materialise(of_print, "components")  # so that the join below has two shuffled sides, and a print of very many copies can be split
    return base.join(of_print, "fp", "left").select("_row", "n_shingles", F.coalesce("component", "_row").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the id is its component's least) of every row."""
    rows = with_row_key(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text")), "doc_id")
    made = near_components(rows, "_text", **how)
    ids = rows.select("_row", "doc_id")
    named = made.join(ids, "_row").join(ids.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that of the least id; of rows that repeat it the first by with_row_key(). An empty table stays empty, columns keep their names."""
    hidden, names = masked(docs)
    at = dict(zip(docs.columns, names))
    rows = with_row_key(hidden, at[doc_id])
    keep = near_components(rows, at[text], **how).where(F.col("_row") == F.col("component")).select("_row")
    return rows.join(keep, "_row", "left_semi").select(*names).toDF(*docs.columns)
