"""Spelling variants: words that differ by one code point, grouped under their frequent forms, by variable-length grams.

A gram starts at every place of a word and grows from two code points on, as long as it is frequent among the words and shorter than
the longest; so frequent grams are extended until they tell words apart, and rare ones stay short. The dictionary holds
the frequent grams alone: a gram is frequent if it occurs more often than total / `most` times, so no more than
`most` of each length are sent to the tasks, whatever the corpus.

One edit spoils only the grams that reach over its place. A word's bound is the largest number of grams that lie over one
of its code points; near words share all their other grams. So if the grams of both words are
ordered from rare to frequent, their first common one is among the bound + 1 first of each: only these lists are merged.
The edit lies on one side of a common gram, so what lies on the other side is the same in both words: a gram's list is cut
up by that and by the words' length. Pairs are verified by edit distance within the join, so candidates are never stored.

Null and empty texts have no words, a null id counts as the empty text, repeated rows count as often as they occur, an empty table gives
an empty one, other columns are not read. Texts and words of any length are taken whole. Ties between forms go to the
word that is smallest in code-point order.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

RUN = re.compile("[a-zÀ-ÿ]+")
_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A task sends its counts when it holds so many words.
HELD = 200_000
#: Forms are broadcast where there are no more than this.
MOST_BROADCAST = 200_000
SHORTEST, LONGEST = 2, 4


def edited(run: str, doc_id: str, every: int = 31) -> str:
    """The run, without one code point where the checksum of document and run says so."""
    h = crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run


def _counted(pairs, batch_of) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=batch_of)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word, n: the runs of letters of all texts, lower-cased and edited, of min_length code points and min_count occurrences at least."""

    def run(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary())):
                if not t.is_valid:
                    continue
                letters = t.as_py().translate(_lower).decode("utf-8", "replace")
                for word, n in Counter(map(re.Match.group, RUN.finditer(letters))).items():
                    if len(word) >= min_length:
                        word = edited(word, key)
                        if len(word) >= min_length:
                            held[word] += n
                if len(held) > HELD:
                    yield _counted(held, ["word", "n"])
                    held.clear()
        yield _counted(held, ["word", "n"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, most: int = 100_000, least: int = 8, longest: int = LONGEST) -> dict[str, int]:
    """The dictionary: grams that occur more than max(least, total of their length / most) times in words, with their counts."""

    def run(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for q in range(SHORTEST, longest + 1):
                    held.update(w[i : i + q] for i in range(len(w) - q + 1))
                if len(held) > HELD:
                    yield _counted(held, ["gram", "n"])
                    held.clear()
        yield _counted(held, ["gram", "n"])

    lengths = range(SHORTEST, longest + 1)
    totals = words.agg(*[F.sum(F.greatest(F.length("word") - q + 1, F.lit(0))).alias(f"q{q}") for q in lengths]).first()
    bounds = {q: max(least, (totals[f"q{q}"] or 0) // most) for q in lengths}
    bound = F.coalesce(*[F.when(F.length("gram") == q, F.lit(b)) for q, b in bounds.items()])
    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.where(F.col("n") > bound).toLocalIterator()}


def grams(word: str, frequent: dict[str, int], longest: int = LONGEST) -> tuple[list[tuple[str, int]], int]:
    """The word's variable-length grams with their places, and how many of them one edit can spoil at most."""
    out, over = [], [0] * (len(word) + 1)
    for i in range(len(word) - SHORTEST + 1):
        end = i + SHORTEST
        while end - i < longest and end < len(word) and word[i:end] in frequent:
            end += 1
        out.append((word[i:end], i))
        over[i] += 1
        over[end] -= 1
    most = lies = 0
    for step in over:
        lies += step
        most = max(most, lies)
    return out, most


def rarest(word: str, frequent: dict[str, int], longest: int = LONGEST) -> list[tuple[str, int]]:
    """Those of the word's grams that suffice to meet every near word: its bound + 1 rarest ones."""
    found, spoiled = grams(word, frequent, longest)
    found.sort(key=lambda g: (frequent.get(g[0], 0), -len(g[0]), g))
    return found[: spoiled + 1]


def near_words(words: DataFrame, min_length: int = 7, most: int = 100_000) -> DataFrame:
    """a, na, b, nb: each pair of words (word, n; distinct, of min_length code points at least) at edit distance one, once."""
    longest = min(LONGEST, min_length - SHORTEST)  # a word has more grams than one edit can spoil
    if longest < SHORTEST:
        raise ValueError(f"words need {2 * SHORTEST} code points at least")
    frequent = words.sparkSession.sparkContext.broadcast(frequent_grams(words, most, longest=longest))

    def run(batches):
        for batch in batches:
            at, place, end = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                for g, p in rarest(w, frequent.value, longest):
                    at.append(i)
                    place.append(p)
                    end.append(p + len(g))
            both = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*both, pa.array(place, pa.int32()), pa.array(end, pa.int32())], names=["word", "n", "place", "end"])

    lists = materialise(words.select("word", "n").mapInArrow(run, "word string, n long, place int, end int"), "grams")
    size = F.length("word")
    # a gram's list holds the words that agree in it and in all that lies on one side of it; a word also looks into those of words one shorter
    keys = lambda *sizes: F.explode(F.array(*[k for s in sizes for k in (F.xxhash64(F.lit(0), F.left("word", "end"), s), F.xxhash64(F.lit(1), F.substring("word", F.col("place") + 1, size), s))]))
    left = lists.select(keys(size).alias("key"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = lists.select(keys(size, size - 1).alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, (left["key"] == right["key"]) & once & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word of each chain of forms (word, form). Each round doubles the steps; chains have no cycles, as forms are more frequent."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        n = now.count()
        step = small(now.select(F.col("word").alias("root"), F.col("root").alias("next")), n, MOST_BROADCAST)
        made = materialise(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = made.select("word", "root")
        if made.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word. A form is the most frequent near word, if it is `times` as frequent."""
    words = materialise(word_counts(docs, doc_id, text, min_length, min_count), "words")
    pairs = materialise(near_words(words, min_length), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("on")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("on")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("on"), F.col("other"))).alias("best"))
    of = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.col1")).alias("form_n"))
    fits = F.col("form_n") >= times * F.col("n")
    of = materialise(of.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "forms")
    made = of.join(roots(of.where(F.col("form").isNotNull())), "word", "left")
    return made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
