"""Host-level quality rules: rule failures by host, shrunk by an empirical beta prior, joined back to documents."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise, small, text_map

SYMBOLS = "#*$%&|<>"
#: Up to so many hosts, verdicts are broadcast, so that rows of a host that has very many stay where they are.
MOST_BROADCAST = 200_000
_word = re.compile(WORD)

STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (b.max() + 1) + b, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[list[str]], width: int = 5) -> np.ndarray:
    """Per document, the words inside any window of width words that its text holds twice or more.

    Windows get exact ranks by joining ranks of shorter runs, so no hash can collide.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    if not len(words) or n.max() < width:
        return out
    flat = pa.array([w for ws in words for w in ws], type=pa.large_string())
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.flatnonzero(at + width <= n[doc])
    ranks, size = {1: ids}, 1  # of the runs of so many words that begin at each place
    while 2 * size <= width:
        ranks[2 * size] = _joined(ranks[size][: len(ids) - 2 * size + 1], ranks[size][size : len(ids) - size + 1])
        size *= 2
    rank, have = ranks[size][starts], size
    while have < width:
        step = max(s for s in ranks if s <= width - have)
        rank, have = _joined(rank, ranks[step][starts + have]), have + step
    _, inverse, times = np.unique(rank * len(words) + doc[starts], return_inverse=True, return_counts=True)
    hit = np.zeros(len(ids), bool)
    again = starts[times[inverse] > 1]
    for step in range(width):
        hit[again + step] = True
    return np.bincount(doc[hit], minlength=len(words))


def text_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns plus STATS of every whole text; a null text counts as empty."""

    def make(rows, texts):
        texts = [t or "" for t in texts]
        words = [_word.findall(t) for t in texts]
        lines = [[x for x in t.split("\n") if _word.search(x)] for t in texts]
        return [
            *[rows[c] for c in keep],
            [len(w) for w in words],
            [sum(map(len, w)) for w in words],
            [sum(map(t.count, SYMBOLS)) for t in texts],
            [len(x) for x in lines],
            [len(x) - len(set(x)) for x in lines],
            repeated_words(words),
        ]

    kinds = dict(docs.dtypes)
    return text_map(docs, keep, text, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + STATS, make)


def beta_prior(hosts: DataFrame, most: float = 1e4) -> tuple[float, float]:
    """Moments of the hosts' failure rates (columns n, failed), as the two parameters of a beta distribution."""
    p = F.col("failed") / F.col("n")
    m = (hosts.agg(F.sum("failed") / F.sum("n")).first() or [None])[0] or 0.0
    v = (hosts.agg(F.sum(F.col("n") * (p - m) * (p - m)) / F.sum("n")).first() or [None])[0] or 0.0
    strength = min(max(m * (1 - m) / v - 1, 1.0), most) if v > 0 else most
    return m * strength, (1 - m) * strength


def judge_hosts(stats: DataFrame, host: str = "source", strict: float = 0.674, drop: float = 2.0) -> DataFrame:
    """Adds base_failed, soft_failed, host_rate, host_verdict and kept to text_stats().

    Base rule: under 10 words, or over 20 % of the words repeated. Soft rules: a symbol for each ten words, mean word
    under 3 or over 12 characters, over 30 % repeated lines. A host's rate is the posterior mean of either failing
    under the empirical prior. Verdicts come from the posterior's tails, in standard deviations: a host is strict if its
    rate lies `strict` of them above the corpus' rate (three chances in four that it is worse), and dropped if it lies
    `drop` of them above one half. Strict hosts lose the documents that fail a soft rule, dropped ones all. Rows without
    a host form a host of their own. An empty table gives an empty result.
    """
    n = F.col("n_words")
    base = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    soft = (
        (10 * F.col("n_symbols") > n)
        | (F.col("word_chars") < 3 * n)
        | (F.col("word_chars") > 12 * n)
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    )
    judged = stats.withColumn("base_failed", base).withColumn("soft_failed", soft).withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit("")))
    hosts = judged.groupBy("_host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failed"))
    hosts = materialise(hosts, "hosts")
    a, b = beta_prior(hosts)
    rate, mean = F.col("host_rate"), a / (a + b)
    spread = F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1))
    verdict = F.when(rate - 0.5 > drop * spread, "drop").when((rate > mean) & (rate - mean >= strict * spread), "strict").otherwise("keep")
    verdicts = hosts.withColumn("host_rate", (F.col("failed") + a) / (F.col("n") + a + b)).select("_host", "host_rate", verdict.alias("host_verdict"))
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "drop") & ~((F.col("host_verdict") == "strict") & F.col("soft_failed"))
    return judged.join(small(verdicts, hosts.count(), MOST_BROADCAST), "_host", "left").withColumn("kept", kept).drop("_host")


def host_quality(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """text_stats() and judge_hosts() of every whole text, however long; repeated rows are judged one by one.

    The statistics, a few numbers a row, go to the shared folder, so texts are read once.
    """
    stats = materialise(text_stats(docs, [doc_id, host], text), "quality")
    return judge_hosts(stats, host, **limits)
