"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The corpus frequency of every benchmark term decides each 13-word window's rarest term. The index stores the
postings (row, position) of those terms, with the words beside each position as payload: within a posting's reach, that
is what the lists of all other terms hold at their offsets, so those lists needn't be written or shuffled. A posting and
an item's occurrence of the term fix an alignment, and the run of equal words around the term is the match.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, materialise, small, with_row_key

#: Everything that isn't part of a word, before A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: The rarest terms' table is broadcast up to so many occurrences in the benchmark, and shuffled beyond.
MOST_BROADCAST = 200_000


def lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def pieces(text: str) -> Column:
    """The text's words, with an empty string in front or behind where it begins or ends with a break."""
    return F.split(F.coalesce(F.col(text), F.lit("")), BREAK, -1)


def word_count(words: Column) -> Column:
    edge = lambda i: (F.try_element_at(words, F.lit(i)) == "").cast("long")
    return F.size(words) - edge(1) - F.when(F.size(words) > 1, edge(-1)).otherwise(0)


def item_words(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """_item (a number for each row), item_id as text, words: rows without a word are left out."""
    words = F.filter(F.split(lower(F.coalesce(F.col(text), F.lit(""))), BREAK, -1), lambda w: w != "")
    made = items.select(F.col(item_id).cast("string").alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    return made.select(F.xxhash64("item_id", "words").alias("_item"), "item_id", "words").dropDuplicates(["_item", "item_id"])


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text: str) -> DataFrame:
    """key, n: how often each benchmark term occurs in the corpus; terms that don't occur are absent."""
    found = docs.select(F.explode(pieces(text)).alias("_w")).select(F.lower("_w").alias("key"))
    if n_terms > MOST_BROADCAST:  # counted within tasks before the shuffle
        return found.groupBy("key").agg(F.count("*").alias("n")).join(terms, "key", "left_semi")
    return found.join(F.broadcast(terms), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For each window its rarest term's place, each place once: key, _item, at, the words to its left (nearest first) and right, need.

    Windows with a term that the corpus lacks can't match and are left out.
    """
    places = items.select("_item", "item_id", "words", F.posexplode("words").alias("at", "_w")).select("*", F.lower("_w").alias("key"))
    known = places.join(counts, "key", "left")
    first = F.greatest(F.col("at") - window + 1, F.lit(0))
    last = F.least(F.col("at"), F.greatest(F.size("words") - window, F.lit(0)))
    in_windows = known.select("_item", "item_id", "at", "n", F.explode(F.sequence(first, last)).alias("start"))
    best = in_windows.groupBy("_item", "item_id", "start").agg(F.min(F.struct("n", "at")).alias("best"), F.max(F.col("n").isNull()).alias("lacks"))
    chosen = best.where(~F.col("lacks")).select("_item", "item_id", F.col("best.at").alias("at")).distinct()
    reach = window - 1
    left = F.reverse(F.slice("words", F.greatest(F.col("at") - reach, F.lit(0)) + 1, F.least(F.col("at"), F.lit(reach))))
    right = F.slice("words", F.col("at") + 2, reach)
    need = F.least(F.size("words"), F.lit(window))
    same = chosen.select(F.col("_item").alias("_i"), F.col("item_id").alias("_id"), F.col("at").alias("_at"))
    both = places.join(same, (F.col("_item") == F.col("_i")) & (F.col("at") == F.col("_at")) & F.col("item_id").eqNullSafe(F.col("_id")))
    return both.select("key", "_item", "item_id", "at", left.alias("ileft"), right.alias("iright"), F.col("_w").alias("iword"), need.alias("need"))


def postings(docs: DataFrame, keys: DataFrame, n_keys: int, text: str, reach: int) -> DataFrame:
    """The index: key, _row, pos, word, and the reach words to the left (nearest first) and right of it."""
    split = docs.select("_row", pieces(text).alias("_words"))
    spread = lambda *c: split.select("_row", *c, F.posexplode("_words").alias("pos", "_w")).select("*", F.lower("_w").alias("key"))
    if n_keys > MOST_BROADCAST:  # only single words are shuffled; the texts of rows with hits are fetched once for each row
        at = spread().select("_row", "pos", "key").join(keys, "key", "left_semi").groupBy("_row").agg(F.collect_list(F.struct("pos", "key")).alias("_at"))
        hit = docs.select("_row", text).join(at, "_row").select("_row", pieces(text).alias("_words"), F.inline("_at")).withColumn("_w", F.element_at("_words", F.col("pos") + 1))
    else:
        hit = spread("_words").join(F.broadcast(keys), "key", "left_semi")
    left = F.reverse(F.slice("_words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach))))
    right = F.slice("_words", F.col("pos") + 2, reach)
    each = lambda ws: F.transform(ws, lower)
    return hit.select("key", "_row", "pos", lower(F.col("_w")).alias("word"), each(left).alias("left"), each(right).alias("right"))


def run_length(a: str, b: str) -> Column:
    """How many words agree from the front of two lists."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """_row, item_id, begin, end (words, end inclusive) of every run of words that consists of an item's windows.

    docs have a unique _row. Items of fewer words than a window must occur whole. Positions count a leading empty
    piece, so they serve to tell words apart, not to find them.
    """
    items = materialise(item_words(benchmark, item_id, item_text), "items")
    terms = items.select(F.explode("words").alias("_w")).select(F.lower("_w").alias("key")).distinct()
    counts = materialise(term_counts(docs, terms, terms.count(), doc_text), "counts")
    wanted = materialise(anchors(items, counts, window), "anchors")
    keys = wanted.select("key").distinct()
    index = materialise(postings(docs, keys, keys.count(), doc_text, window - 1), "postings")
    aligned = index.join(small(wanted, wanted.count(), MOST_BROADCAST), "key").where(F.col("word") == F.col("iword"))
    runs = aligned.select("_row", "item_id", "pos", "need", run_length("left", "ileft").alias("l"), run_length("right", "iright").alias("r"))
    whole = runs.where(F.col("l") + F.col("r") + 1 >= F.col("need"))
    return whole.select("_row", "item_id", (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r")).alias("end"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int, item_id: str = "item_id", doc_text: str = "text", item_text: str = "text") -> DataFrame:
    """_row, item_id, pos: places of an item's rarest term with all its other terms within its length plus slop words, in any order.

    Postings carry as many words on both sides as the longest item has, plus slop.
    """
    items = materialise(item_words(benchmark, item_id, item_text).select("item_id", "words"), "items")
    terms = items.select(F.explode("words").alias("_w")).select(F.lower("_w").alias("key")).distinct()
    longest = items.agg(F.max(F.size("words"))).first()[0] or 1
    counts = materialise(term_counts(docs, terms, terms.count(), doc_text), "counts")
    places = items.select("item_id", "words", F.explode("words").alias("_w")).select("*", F.lower("_w").alias("key")).join(counts, "key", "left")
    rarest = places.groupBy("item_id", "words").agg(F.min(F.struct("n", "key", "_w")).alias("b"), F.max(F.col("n").isNull()).alias("lacks")).where(~F.col("lacks"))
    wanted = rarest.select("item_id", "words", F.col("b.key").alias("key"), F.col("b._w").alias("iword"))
    keys = wanted.select("key").distinct()
    index = postings(docs, keys, keys.count(), doc_text, longest - 1 + slop)
    reach = F.size("words") - 1 + slop
    near = F.concat(F.slice("left", F.lit(1), reach), F.array("word"), F.slice("right", F.lit(1), reach))
    both = index.join(small(wanted, wanted.count(), MOST_BROADCAST), "key").where(F.col("word") == F.col("iword"))
    return both.where(F.size(F.array_except("words", near)) == 0).select("_row", "item_id", "pos").distinct()


def judged(rows: DataFrame, benchmark: DataFrame, keep: list[str], text: str, item_id: str, item_text: str, share: int, window: int) -> DataFrame:
    """keep columns and those of contamination(), for rows with a unique _row."""
    hits = materialise(phrase_matches(rows, benchmark, item_id, text, item_text, window), "hits")
    words = hits.select("_row", F.explode(F.sequence("begin", "end")).alias("at")).distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    items = hits.select("_row", "item_id").distinct().groupBy("_row").agg(F.count("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("_items"))
    base = rows.select("_row", *keep, pieces(text).alias("_words")).select("_row", *keep, word_count(F.col("_words")).cast("long").alias("n_words"))
    n_hit, n_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_items", F.lit(0).cast("long"))
    return (
        base.join(words, "_row", "left").join(items, "_row", "left")
        .select("_row", *keep, "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Contaminated: some word is hit, and at least one word in `share`. Null texts have no words; repeated rows and
    repeated ids are judged row by row, very long texts whole; without benchmark rows nothing is hit. Other columns of
    docs don't matter. Items of null id count for n_hit and
    contaminated, not for n_items and items_sha256.
    """
    rows = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    return judged(rows, benchmark, ["doc_id"], "_text", item_id, item_text, share, window).drop("_row")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows. Null and empty texts stay, very long ones are judged whole, repeated rows one by one; an empty table stays empty; columns keep their names."""
    hidden, names = masked(docs)
    at = dict(zip(docs.columns, names))
    rows = with_row_key(hidden, at[doc_id])
    bad = judged(rows, benchmark, [], at[text], item_id, item_text, share, window).where("contaminated").select("_row")
    return rows.join(bad, "_row", "left_anti").select(*names).toDF(*docs.columns)
