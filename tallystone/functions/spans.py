"""Positions of pattern matches in JVM expressions: Spark gives the matched texts, split() gives the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def running(sizes: Column) -> Column:
    """Running sums of a non-empty array, by sums over blocks, so that long arrays don't cost the square of their length."""
    n = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(sizes, b * BLOCK + 1, BLOCK)))
    one = lambda bs: F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: total(F.slice(bs, F.lit(1), F.floor(i / BLOCK).cast("int"))) + total(F.slice(sizes, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK) + 1)),
    )
    return F.element_at(F.transform(F.array(blocks), one), 1)  # the blocks' sums are computed once: they pass through a one-element array


def last_words(text: Column, n: int) -> Column:
    """The last n words, or fewer; the reversed text is matched from its front, so long words cost no more than their length."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^\s*+(\S++(?:\s++\S++){0,%d}+)" % (n - 1), 1))


def with_matches(df: DataFrame, name: str, text: str, pattern: str, guard: Column, words: int = 0) -> DataFrame:
    """Adds array column name: struct(start, end, hit) of the pattern's matches, or null; positions are code points.

    With words also `before`: so many whole words of the text in front of the match. They may lie before the two matches
    in front of it, as each of these is a part of a word at least. The pattern is only tried where guard holds. Steps are columns of their
    own, so that no step is computed twice.
    """
    t, none = F.col(text), F.array().cast("array<string>")
    cut = df.withColumn("_gaps", F.when(guard, F.split(t, pattern, -1)).otherwise(none)).withColumn("_hits", F.when(guard, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    sizes = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_hits")), F.col("_hits"), lambda g, h: F.length(g) + F.length(h))
    placed = cut.withColumn("_sizes", sizes).withColumn("_ends", F.when(F.size("_sizes") > 0, running(F.col("_sizes"))).otherwise(F.array().cast("array<int>")))
    pack = F.zip_with(
        F.arrays_zip("_ends", "_hits"), "_befores" if words else "_hits",
        lambda x, b: F.struct((x["_ends"] - F.length(x["_hits"])).alias("start"), x["_ends"].alias("end"), x["_hits"].alias("hit"), *([b.alias("before")] if words else [])),
    )
    if words:
        gap, hit = (lambda i, c=c: F.coalesce(F.get(c, i), F.lit("")) for c in ("_gaps", "_hits"))
        lead = lambda i: F.concat(*[x for k in (2, 1) for x in (gap(i - k), hit(i - k))], gap(i))
        each = F.transform(F.sequence(F.lit(0), F.size("_hits") - 1), lambda i: last_words(lead(i), words))
        placed = placed.withColumn("_befores", F.when(F.size("_hits") > 0, each).otherwise(none))
    return placed.withColumn(name, F.when(F.size("_hits") > 0, pack)).drop("_gaps", "_hits", "_sizes", "_ends", "_befores")
