"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A 3-gram is the product of its letters' vectors, each rolled by
its place; a text is the sum of its 3-grams; a language is the sum of its training texts. A text takes the language of
the prototype with the highest cosine, which is also the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, masked, others, text_map

DIM = 1024
BLOCK = 256  # texts whose 3-gram counts are multiplied at once
PART = 1 << 20  # characters of one text that are taken at once
LEAST = 16  # 3-grams up to which a cosine says nothing
RARE = 200  # one labelled row in so many may lie under its language's limit
SLACK = 0.85  # the limit's share of that quantile
NOISE = 4.0  # standard deviations of a random vector's cosine that every limit lies above
USUAL = 1e-4  # share of a language's letters from which a letter is usual
_letters: dict[int, np.ndarray] = {}


def letter(code: int, dim: int) -> np.ndarray:
    """The random vector of a code point: the same in every process, from a generator seeded by the code point."""
    if (code, dim) not in _letters:
        _letters[code, dim] = np.random.Generator(np.random.PCG64(code)).integers(0, 2, dim).astype(np.float32) * 2 - 1
    return _letters[code, dim]


def clean(text: str | None) -> str:
    """Lower-case letters, with one blank for any run of other characters and at both ends; empty without letters."""
    if not text:
        return ""
    words = "".join([c if c.isalpha() else " " for c in text.lower()]).split() if not text.isascii() else text.lower().translate(_ASCII).split()
    return f" {' '.join(words)} " if words else ""


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def ranks(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of x, all under size, and each element's place among them."""
    if size > 1 << 23:
        return np.unique(x, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[x] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[x]


def bundle(texts: list[str], dim: int, groups: np.ndarray | None = None, n_groups: int = 0) -> np.ndarray:
    """Sums of 3-gram vectors, one row per text, or per group of texts where groups are given."""
    rows = np.arange(len(texts)) if groups is None else groups
    n_rows = len(texts) if groups is None else n_groups
    out = np.zeros((n_rows, dim), np.float32)
    for i, t in enumerate(texts):  # a very long text comes in parts that share no 3-gram
        if len(t) > PART + 2:
            for a in range(0, len(t) - 2, PART):
                out[rows[i]] += bundle([t[a : a + PART + 2]], dim)[0]
    texts = [t if len(t) <= PART + 2 else "" for t in texts]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    if n.sum() < 3:
        return out
    points, at = ranks(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), 0x110000)
    k = len(points)
    at = at.astype(np.int64)
    inside = np.ones(len(at), bool)  # a 3-gram may not run over a text's end
    ends = np.cumsum(n)
    for back in (1, 2):
        inside[(ends - back)[n >= back]] = False
    start = np.flatnonzero(inside[: len(at) - 2])
    if not len(start):
        return out
    grams, gram = ranks((at[start] * k + at[start + 1]) * k + at[start + 2], k**3)
    row = np.repeat(rows, n)[start]
    if groups is not None:
        order = np.argsort(row, kind="stable")
        row, gram = row[order], gram[order]
    base = np.stack([letter(int(p), dim) for p in points])
    twice, once = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    for a in range(0, n_rows, BLOCK):
        size = min(BLOCK, n_rows - a)
        low, high = np.searchsorted(row, [a, a + size])
        used, local = ranks(gram[low:high], len(grams))
        if not len(used):
            continue
        counts = np.bincount((row[low:high] - a) * len(used) + local, minlength=size * len(used)).reshape(size, len(used)).astype(np.float32)
        g = grams[used]
        out[a : a + size] += counts @ (twice[g // (k * k)] * once[g // k % k] * base[g % k])
    return out


def profiles(labelled: DataFrame, text: str, lang: str, dim: int = DIM) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Prototypes and numbers of 3-grams by language, over all rows. Each task sends one row per language and dimension, and one more, at most."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([len(t) + 64 for t in texts], 1_000_000):
                names, of = np.unique(np.array(langs[a:b], dtype=object).astype(str), return_inverse=True)
                ready = [clean(t) for t in texts[a:b]]
                grams = np.bincount(of, [max(0, len(t) - 2) for t in ready], len(names))
                for name, v, n in zip(names.tolist(), bundle(ready, dim, of, len(names)), grams):
                    sums[name] = sums.get(name, 0) + np.append(v.astype(np.float64), n)
        for name, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * (dim + 1), "i": np.arange(dim + 1, dtype=np.int32), "v": v})

    parts = labelled.select(F.col(text), F.col(lang).cast("string")).mapInArrow(partial, "lang string, i int, v double")
    rows = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()  # languages times dimensions
    found: dict[str, np.ndarray] = {}
    for name, i, v in rows:
        found.setdefault(name, np.zeros(dim + 1))[i] = v
    return {name: found[name][:dim] for name in sorted(found)}, {name: float(v[dim]) for name, v in found.items()}


def train(labelled: DataFrame, text: str, lang: str, dim: int = DIM) -> dict[str, np.ndarray]:
    """The prototypes of profiles()."""
    return profiles(labelled, text, lang, dim)[0]


def halves(prototypes: dict[str, np.ndarray], grams: dict[str, float]) -> dict[str, float]:
    """By language, 1 / s, where s is how alike two of its 3-grams are on average. n 3-grams drawn from it have a cosine of about sqrt(n / (n + 1 / s)) with all."""
    return {name: len(p) * grams[name] ** 2 / max(float(p @ p), 1e-9) for name, p in prototypes.items()}


def weight(n: np.ndarray, half: np.ndarray | float) -> np.ndarray:
    """What part of a long text's cosine n 3-grams must reach: what is to be expected of so many, less for chance, from 0 at LEAST towards 1 without a step."""
    return np.sqrt(n / (n + half)) * np.maximum(0, 1 - LEAST / np.maximum(n, 1))


def calibrate(labelled: DataFrame, text: str, lang: str, prototypes: dict[str, np.ndarray], half: dict[str, float]) -> tuple[dict[str, float], np.ndarray, dict[str, float]]:
    """The least cosine of a long text by language, the usual letters (sorted code points), and half, from all labelled rows.

    A row's cosine is taken with the sum of its language's other rows, and divided by its length's weight(). A language's
    limit lies SLACK under the figure that one row in RARE stays below, and over the noise. Languages of few rows take the quantile of all languages.
    Tasks send counts by hundredths of a cosine and by letter.
    """
    dim = len(next(iter(prototypes.values()))) if prototypes else DIM

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool, int], int] = {}
        for batch in batches:
            texts, langs = [clean(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in chunks([len(t) + 64 for t in texts], 1_000_000):
                made = bundle(texts[a:b], dim).astype(np.float64)
                names = np.array(langs[a:b], dtype=object)
                for name in set(langs[a:b]):
                    of = np.flatnonzero(names == name)
                    own, rest = made[of], prototypes[name] - made[of]
                    size = np.linalg.norm(own, axis=1) * np.linalg.norm(rest, axis=1)
                    ask = weight(np.array([max(0, len(texts[a + i]) - 2) for i in of]), half[name]) * size
                    some = ask > 0
                    bins = (np.clip((own * rest).sum(axis=1)[some] / ask[some], 0, 1) * 100).astype(int)
                    points = np.frombuffer("".join(texts[a + i] for i in of).replace(" ", "").encode("utf-32-le"), np.uint32)
                    for is_letter, values in ((False, bins), (True, points)):
                        for v, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                            counts[name, is_letter, v] = counts.get((name, is_letter, v), 0) + n
        if counts:
            names, kinds, values = zip(*counts)
            yield pa.RecordBatch.from_pydict({"lang": list(names), "letter": list(kinds), "v": pa.array(values, pa.int32()), "n": list(counts.values())})

    parts = labelled.select(F.col(text), F.col(lang).cast("string")).mapInArrow(partial, "lang string, letter boolean, v int, n long")
    bins, letters = {name: np.zeros(101) for name in prototypes}, {name: {} for name in prototypes}
    for name, is_letter, v, n in parts.groupBy("lang", "letter", "v").agg(F.sum("n").alias("n")).collect():  # languages times bins and letters
        if is_letter:
            letters[name][v] = n
        else:
            bins[name][v] = n
    low = lambda h: np.searchsorted(np.cumsum(h), h.sum() / RARE, side="right") / 100 if h.sum() else 0.0
    together = low(sum(bins.values(), np.zeros(101)))
    limits = {name: max(NOISE / dim**0.5, SLACK * (low(h) if h.sum() >= RARE else together)) for name, h in bins.items()}
    usual = {v for of in letters.values() for v, n in of.items() if n >= USUAL * sum(of.values())}
    return limits, np.array(sorted(usual), np.uint32), half


def usual_text(text: str, usual: np.ndarray) -> bool:
    """Whether at least half of a clean text's letters are usual ones."""
    points = np.frombuffer(text.replace(" ", "").encode("utf-32-le"), np.uint32)
    return 2 * int(np.isin(points, usual).sum()) >= len(points) > 0


def identify(docs: DataFrame, keep: list[str], prototypes: dict[str, np.ndarray], text: str = "text", limits: tuple[dict[str, float], np.ndarray, dict[str, float]] | None = None) -> DataFrame:
    """keep columns, lang_pred, score of every whole text: `und` and 0 without text, letter or prototype.

    Equal cosines go to the first language by name. Rows are judged one by one, so repeated ones need no rule; columns
    of docs named as the new ones give way to them. With what calibrate() gives also is_known: the score reaches the language's
    limit times the length's weight(), and at least half of the letters are usual ones.
    """
    keep = others(keep, "lang_pred", "score", *([] if limits is None else ["is_known"]))
    names = list(prototypes)
    dim = len(next(iter(prototypes.values()))) if names else DIM
    table = np.stack([p / (np.linalg.norm(p) or 1) for p in prototypes.values()]).astype(np.float32) if names else np.zeros((0, dim), np.float32)

    def make(rows, texts):
        ready = [clean(t) for t in texts]
        made = bundle(ready, dim)
        size = np.linalg.norm(made, axis=1)
        cosine = (made @ table.T) / np.maximum(size, 1e-9)[:, None] if names else np.zeros((len(ready), 1))
        known = np.array([bool(r) for r in ready]) & bool(names)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine.max(axis=1), 0, 1).astype(float)
        out = [*[rows[c] for c in keep], [names[i] if k else "und" for i, k in zip(best, known)], np.where(known, score, 0.0)]
        if limits is None:
            return out
        n = np.array([max(0, len(t) - 2) for t in ready], float)
        ask = np.array([limits[0][names[i]] for i in best]) * weight(n, np.array([limits[2][names[i]] for i in best])) if names else n
        return [*out, [bool(k and s >= a) and usual_text(t, limits[1]) for t, k, s, a in zip(ready, known, score, ask)]]

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double" + ("" if limits is None else ", is_known boolean")
    return text_map(docs, keep, text, schema, make, 1_000_000)


def labelled_rows(docs: DataFrame, doc_id: str, text: str, lang: str, folds: int, held: int) -> DataFrame:
    """The rows outside the held-out fold that have a language and a text."""
    return docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(doc_id, folds) != held))


def learn_and_identify(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the rows outside the held-out fold that have a language, then labels every row. An empty table gives an empty result."""
    return identify(docs, keep, train(labelled_rows(docs, doc_id, text, lang, folds, held), text, lang), text)


def in_known_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """docs without the rows whose text has no letter, or is noise or in no learned language by the limits of calibrate().

    Null and empty texts go, very long ones are judged whole, repeated rows one by one; an empty table stays empty; columns keep their names.
    """
    hidden, names = masked(docs)
    at = dict(zip(docs.columns, names))
    labelled = labelled_rows(hidden, at[doc_id], at[text], at[lang], folds, held)
    prototypes, grams = profiles(labelled, at[text], at[lang])
    made = identify(hidden, names, prototypes, at[text], calibrate(labelled, at[text], at[lang], prototypes, halves(prototypes, grams)))
    return made.where("is_known").select(*names).toDF(*docs.columns)
