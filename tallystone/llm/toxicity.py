"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are words, word beginnings, and beginnings that come twice or three times in a text. A bounded labelled sample
decides which of them are voters at all. The label model then sees only how voters fire over unlabelled documents: it
gives each voter its firing rates under both labels, and correlated voters an edge of a dependency forest, by EM. The
labelled sample's counts are its prior; no document's own label takes part in its posterior. A logistic classifier
over the voters is fitted to the posteriors, and the labels calibrate its threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, others, text_map

_word = re.compile(r"[^\W\d_]+")
HEADS = (4, 5, 6)  # lengths of word beginnings
TIMES = (1, 2, 3)  # how often a beginning comes, at least


def marks(text: str | None) -> set[str]:
    """A text's marks: its words, lower-cased, and `x*`, `x*2`, `x*3` for the beginnings of longer words, by how often they come."""
    words = _word.findall((text or "").lower())
    out = set(words)
    for n in HEADS:
        for h, k in Counter([w[:n] for w in words if len(w) > n]).items():
            out.update([f"{h}*{t if t > 1 else ''}" for t in TIMES if t <= k])
    return out


def signature(text: str | None) -> str:
    """Two min-hashes of the text's different words: near copies nearly always share both."""
    words = set(_word.findall((text or "").lower()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return f"{h.min()}-{(h * np.uint64(0x9E3779B97F4A7C15)).min()}" if words else ""


class Voters:
    """Finds which of the given marks a text has, without making all of its marks."""

    def __init__(self, names):
        self.names = set(names)
        self.heads = [(n, some) for n in HEADS if (some := {k[:n] for k in self.names if k.find("*") == n})]

    def fired(self, text: str | None) -> list[str]:
        words = _word.findall((text or "").lower())
        out = self.names & set(words)
        for n, some in self.heads:
            for h, k in Counter([x for x in [w[:n] for w in words if len(w) > n] if x in some]).items():
                out.update(self.names & {f"{h}*{t if t > 1 else ''}" for t in TIMES if t <= k})
        return sorted(out)


def learn_voters(sample: DataFrame, text: str, label: str, least: int = 5, ratio: float = 4.0, sure: float = 20.0) -> list[str]:
    """Marks that at least `least` toxic texts have, at least half of all that have it, `ratio` times likelier in toxic
    than in other texts, by a log-likelihood ratio (twice the logarithm) of `sure` or more. All such marks count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = Counter(), Counter()
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (t if y else c).update(marks(x))
        names = list(t.keys() | c.keys())
        yield pa.RecordBatch.from_pydict({"mark": pa.array(names, pa.string()), "t": pa.array([t[m] for m in names], pa.int64()), "c": pa.array([c[m] for m in names], pa.int64())})

    n1, n0 = sample.agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)), F.coalesce(F.sum(1 - F.col(label).cast("long")), F.lit(0))).first()
    if not n1:
        return []
    by = sample.select(text, label).mapInArrow(partial, "mark string, t long, c long").groupBy("mark").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n, share = F.col("t") + F.col("c"), n1 / (n1 + n0)
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (n * p))).otherwise(0.0) if p else F.lit(0.0)
    lift = ((F.col("t") + 0.5) / (n1 + 1.0)) / ((F.col("c") + 0.5) / (n0 + 1.0))
    good = by.where((F.col("t") >= least) & (F.col("t") >= F.col("c")) & (lift >= ratio) & (2 * (part("t", share) + part("c", 1 - share)) >= sure))
    return [r.mark for r in good.orderBy(F.desc("t"), "mark").select("mark").collect()]


def forest(votes: np.ndarray, weights: tuple[np.ndarray, np.ndarray], least: float = 3.0) -> np.ndarray:
    """Each voter's parent, or -1: the maximum spanning forest of the mutual information that voters have under each label."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    for w in weights:
        s = w.sum() + 1e-9
        one = (w @ votes) / s
        both = (votes * w[:, None]).T @ votes / s
        for a in (0, 1):
            for b in (0, 1):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                alone = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
                gain += s * np.where(joint > 1e-9, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(alone, 1e-12)), 0)
    parent, near, best, done = -np.ones(m, int), -np.ones(m, int), np.full(m, -1.0), np.zeros(m, bool)
    for _ in range(m):
        i = int(np.argmax(np.where(done, -2.0, best)))
        done[i] = True
        parent[i] = near[i] if best[i] > least else -1
        closer = (gain[i] > best) & ~done
        best[closer], near[closer] = gain[i][closer], i
    return parent


def evidence(votes: np.ndarray, parent: np.ndarray, weights: tuple[np.ndarray, np.ndarray], prior: float = 5.0) -> np.ndarray:
    """Log-odds of label 1 that the votes give, with rates from samples weighted by each label.

    A voter that fires counts by its rate given whether its parent fires; one that doesn't counts only where its parent
    does, for silence says nothing about texts of another language or subject. No vote at all counts by the share of
    such samples. Rates given a firing parent lean to the labels' common one, so repeated evidence isn't counted twice.
    """
    over = votes[:, np.maximum(parent, 0)] * (parent >= 0)
    some = votes.sum(1) > 0
    every = weights[0] + weights[1]
    common = (every @ (votes * over) + 0.005) / (every @ over + 0.01)
    z = np.zeros(len(votes))
    for sign, w in ((1, weights[1]), (-1, weights[0])):
        s, fires, above, both = w.sum(), w @ votes, w @ over, w @ (votes * over)
        given = np.clip((both + prior * common) / (above + prior), 1e-6, 1 - 1e-6)
        alone = np.clip((fires - both + 0.5 * fires / max(s, 1e-9) + 1e-3) / (s - above + 0.5), 1e-6, 1 - 1e-6)
        z += sign * (votes * np.log(np.where(over > 0, given, alone)) + (1 - votes) * over * np.log1p(-given)).sum(1)
        z += sign * np.where(some, 0.0, np.log(1 - np.clip((w @ some + 1) / (s + 2), 0.001, 0.999)))
    return z


def label_model(votes: np.ndarray, known: np.ndarray, labels: np.ndarray, trust: float = 2.0, rounds: int = 20, again: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of votes (samples by voters, 0/1), and the voters' parents.

    known and labels are the labelled samples: their counts, weighted to `trust` times the number of rows, are the prior
    of all rates; the forest is found anew every `again` rounds.
    """
    both = np.vstack([votes, known])
    n, share = len(votes), trust * len(votes) / max(1, len(known))
    rest = (share * (1 - labels), share * labels)
    odds = np.log(max(labels.mean(), 1e-3) / max(1 - labels.mean(), 1e-3))
    q = None
    for k in range(rounds):
        mine = (np.zeros(n), np.zeros(n)) if q is None else (1 - q, q)
        weights = tuple(np.concatenate(x) for x in zip(mine, rest))
        if k % again == 0:
            parent = forest(both, weights)
        q = 1 / (1 + np.exp(-np.clip(odds + evidence(both, parent, weights)[:n], -30, 30)))
    return q, parent


def distinct_columns(votes: np.ndarray) -> np.ndarray:
    """The columns to keep: of voters that fire in the same samples the first."""
    return np.sort(np.unique(votes.astype(bool), axis=1, return_index=True)[1])


def fit_linear(votes: np.ndarray, target: np.ndarray, ridge: float = 1e-4, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps, both classes given the same weight."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    share = np.where(target > 0.5, 0.5 / max(1.0, (target > 0.5).sum()), 0.5 / max(1.0, (target <= 0.5).sum()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9  # the bias is free
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ ((target - p) * share) - penalty * w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def calibrated(logits: np.ndarray, given: np.ndarray, bias: float, cut: float) -> float:
    """The bias with which the score `cut` is the threshold of the best F1 on the given labels, halfway between the samples beside it."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], given[order]
    last = np.flatnonzero(np.concatenate([z[1:] != z[:-1], [True]]))  # a threshold can't part equal samples
    hits = np.cumsum(y)[last]
    f1 = 2 * hits / (last + 1 + y.sum())
    best = int(np.argmax(f1))
    below = z[last[best] + 1] if last[best] + 1 < len(z) else z[last[best]] - 2
    return bias + float(np.log(cut / (1 - cut)) - (z[last[best]] + below) / 2)


def drawn_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """_id, _text, _y (null: unlabelled), _free (drawn for the label model): of near copies one row.

    Up to `sample` labelled rows and as many documents of any kind are drawn by the hash of their id, outside the
    held-out fold. Where labels repeat an id, toxic wins. The drawn ids (20 bytes each) are broadcast to find the texts.
    """
    usable = lambda df: df.where(F.col(doc_id).isNotNull() & (fold(doc_id, folds) != held)).select(F.col(doc_id).alias("_id"), "*")
    first = lambda df: df.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    given = first(usable(labels.where(F.col(label).isin(0, 1))).groupBy("_id").agg(F.max(F.col(label).cast("int")).alias("_y")))
    free = first(usable(docs.select(doc_id)).select("_id").distinct())
    drawn = given.select("_id", "_y", F.lit(False).alias("_free")).unionByName(free.select("_id", F.lit(None).cast("int").alias("_y"), F.lit(True).alias("_free")))
    drawn = drawn.groupBy("_id").agg(F.max("_y").alias("_y"), F.max("_free").alias("_free"))
    found = materialise(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id"), "drawn")
    ids = dict(found.dtypes)["_id"]
    signed = text_map(found, ["_id", "_y"], "_text", f"_id {ids}, _y int, _sig string", lambda rows, texts: [rows["_id"], rows["_y"], [signature(t) for t in texts]])
    # labelled rows stand for their near copies before unlabelled ones do
    one = signed.groupBy("_sig").agg(F.min(F.struct(F.col("_y").isNull().alias("n"), F.xxhash64("_id").alias("h"), F.col("_id").alias("_id"))).alias("s")).select("s._id").distinct()
    return found.join(F.broadcast(one), "_id")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3, held: int = 1, sample: int = 12_000, trust: float = 2.0, cut: float = 0.7) -> tuple[dict[str, float], float]:
    """Weights by mark, and the bias. Learns from `sample` labelled and `sample` unlabelled rows outside the held-out fold."""
    rows = drawn_rows(docs, labels, doc_id, text, label, folds, held, sample)
    names = learn_voters(rows.where(F.col("_y").isNotNull()), "_text", "_y")
    if not names:
        return {}, -4.0
    at = {v: i for i, v in enumerate(names)}

    def make(kept, texts):
        voters = Voters(at)
        return [kept["_y"], kept["_free"], [[at[m] for m in voters.fired(t)] for t in texts]]

    fired = text_map(rows, ["_y", "_free"], "_text", "_y int, _free boolean, fired array<int>", make)
    table = sorted(fired.collect(), key=lambda r: (-1 if r._y is None else r._y, r._free, r.fired))  # at most 2 * sample rows
    votes = np.zeros((len(table), len(names)), np.float32)
    for i, r in enumerate(table):
        votes[i, r.fired] = 1
    kept = distinct_columns(votes)
    votes, names = votes[:, kept], [names[i] for i in kept]
    is_known, is_free = np.array([r._y is not None for r in table]), np.array([r._free for r in table])
    known, given = votes[is_known], np.array([r._y for r in table if r._y is not None])
    free = votes[is_free] if is_free.any() else votes
    w, b = fit_linear(free, label_model(free, known, given, trust)[0])
    b = calibrated(known @ w + b, given, b, cut)
    return {v: float(x) for v, x in zip(names, w) if x}, b


def score(docs: DataFrame, keep: list[str], weights: dict[str, float], bias: float, text: str = "text", cut: float = 0.7) -> DataFrame:
    """keep columns, score, predicted of every whole text, however long; empty and null texts score as texts in which no voter fires.

    Repeated rows are scored one by one. Columns of docs named score or predicted give way to those made here.
    """
    keep = others(keep, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # at most as many as there are voters

    def make(rows, texts):
        known = shared.value
        voters = Voters(known)
        out = [1 / (1 + np.exp(-max(-30.0, min(30.0, bias + sum(known[v] for v in voters.fired(t)))))) for t in texts]
        return [*[rows[c] for c in keep], out, [int(s >= cut) for s in out]]

    kinds = dict(docs.dtypes)
    return text_map(docs, keep, text, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double, predicted int", make)


def learn_and_score(docs: DataFrame, labels: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **how) -> DataFrame:
    """train(), then score() of every row, repeated ones too. Rows of equal texts get equal scores; where labels of one id clash, toxic wins; an empty table gives an empty result."""
    weights, bias = train(docs, labels, doc_id, text, label, **how)
    return score(docs, keep, weights, bias, text)
