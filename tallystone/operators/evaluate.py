"""Evaluation of evidence against the required metrics: scorecard, coverage, conflicts, reconciliation.

Evidence is aggregated first, with map-side partial aggregation, and joined to the few required metrics afterwards. No
group of evidence rows is collected except where the result itself lists its rows, and then only what it lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored


def upper_median(counts: DataFrame, by: list[str], value: str, n: str, buckets: int = 4096, rounds: int = 2, most: int | None = None, sortable: int = 1_000_000) -> DataFrame:
    """by, median: exactly the value at place total div 2 of each group's sorted values, each value counted n times.

    A histogram over each group's range finds the bucket of that place, and the next round cuts that bucket's own range
    again, so that an outlier can't put all values into one; only the last bucket's distinct values are sorted. So no
    task sorts a whole group, though a group may hold most rows. Where it is known that no group has more than `most`
    rows of counts, and a task can sort that many, the rounds are left out; the median is the same.
    """
    rounds = rounds if most is None or most > sortable else 0
    want = counts.groupBy(*by).agg((F.floor(F.sum(n) / 2) + 1).alias("_want"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    inside = counts.select(*by, value, n)
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    up_to = F.sum("_k").over(Window.partitionBy(*by).orderBy("_b"))
    for _ in range(rounds):
        placed = inside.join(F.broadcast(want), by).select(*by, value, n, "_want", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("_b"))
        hist = placed.groupBy(*by, "_b", "_want").agg(F.sum(n).alias("_k"), F.min(value).alias("_lo"), F.max(value).alias("_hi")).withColumn("_to", up_to)
        want = hist.where((F.col("_to") >= F.col("_want")) & (F.col("_to") - F.col("_k") < F.col("_want"))).select(*by, (F.col("_want") - F.col("_to") + F.col("_k")).alias("_want"), "_lo", "_hi")
        inside = inside.join(F.broadcast(want.select(*by, "_lo", "_hi")), by).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).select(*by, value, n)
    within = F.sum(n).over(Window.partitionBy(*by).orderBy(value))
    last = inside.withColumn("_to", within).join(F.broadcast(want.select(*by, "_want")), by)
    return last.where(F.col("_to") >= F.col("_want")).groupBy(*by).agg(F.min(value).alias("median"))


def agreement(counts: DataFrame, by: list[str], value: str, n: str, pct: float, most: int | None = None) -> DataFrame:
    """by, n_all, n_agree: how many values lie within pct percent of the upper median; with a median of 0 all zeros do.

    Groups are those of the required metrics, a stated list, so their medians are broadcast.
    """
    m = upper_median(counts, by, value, n, most=most)
    v, med = F.col(value), F.col("median")
    near = F.when(med == 0, v == 0).otherwise(F.abs(v - med) / F.when(med != 0, med) <= pct / 100)
    return counts.join(F.broadcast(m), by).groupBy(*by).agg(F.sum(n).alias("n_all"), F.sum(F.when(near, F.col(n)).otherwise(0)).alias("n_agree"))


def facts(evidence: DataFrame, **more: list[str]) -> DataFrame:
    """Evidence in one scan, aggregated by metric and number, by metric and source, and by the columns that `more` names: stored.

    Columns: kind (value, source, or the name in `more`), those grouped by, n and n_values (rows, and rows with a value),
    best (least tier_rank, then first row, its source), first (the first row and its source), high and gold (any such
    row). Each task aggregates its own rows before the shuffle, so what is shuffled and stored grows with the different
    numbers and sources, and rows themselves are never written. A null metric, number or source is a group of its own.
    """
    sets = {"value": ["metric", "value_num"], "source": ["metric", "source_citation"], **more}
    by = sorted({c for s in sets.values() for c in s})
    kinds = dict(evidence.dtypes)
    source = F.col("source_citation").alias("source_citation")
    ranks = {"best": F.struct("tier_rank", "_ord", source), "first": F.struct("_ord", source)}

    def entry(kind: str, cols: list[str]) -> Column:
        """What one row adds to one set; first rows are of use among numbers only."""
        keys = [(F.col(c) if c in cols else F.lit(None).cast(kinds[c])).alias(c) for c in by]
        firsts = [(x if kind == "value" else F.when(F.lit(False), x)).alias(c) for c, x in ranks.items()]
        high, gold = F.col("computed_confidence") == "high", F.col("tier_rank") == 0
        return F.struct(F.xxhash64(F.lit(kind), *cols).alias("_key"), F.lit(kind).alias("kind"), *keys, *firsts, F.col("value").isNotNull().alias("_valued"), high.alias("high"), gold.alias("gold"))

    rows = evidence.select(F.inline(F.array(*[entry(k, s) for k, s in sets.items()])))
    # rows are sorted by group, for structs have no place in a hash map: the key's hash comes first, as it nearly always decides
    out = rows.groupBy("_key", "kind", *by).agg(F.count("*").alias("n"), F.count_if("_valued").alias("n_values"), F.min("best").alias("best"), F.min("first").alias("first"), F.max("high").alias("high"), F.max("gold").alias("gold"))
    return stored(out.drop("_key"), "facts")


def sources_of(required: DataFrame) -> DataFrame:
    """metric_id, metric, own: a required metric's own id, and its evidence ids."""
    own = required.select("metric_id", F.col("metric_id").alias("metric"), F.lit(True).alias("own"))
    return own.unionByName(required.select("metric_id", F.explode(F.array_distinct("evidence_ids")).alias("metric"), F.lit(False).alias("own")))


def scorecard(evidence: DataFrame, required: DataFrame, agreement_pct: float = 20.0) -> DataFrame:
    """scorecard_of() the facts of the required metrics' rows."""
    return scorecard_of(facts(evidence.join(F.broadcast(sources_of(required).select("metric").distinct()), "metric", "left_semi")), required, agreement_pct)


def scorecard_of(facts: DataFrame, required: DataFrame, agreement_pct: float = 20.0) -> DataFrame:
    """One row per required metric: best value and source, range, numbers of sources and values, agreement, status.

    A metric's own rows count, or those of its evidence ids if it has none: both are summed, side by side. The best value is the largest of the best tier; ties go to the first row by _ord. Without a number the first
    row's source is shown. Ready needs agreement, and a row of high confidence under the metric's own id or a gold value.
    """
    by = ["metric_id", "own"]
    links = F.broadcast(sources_of(required))
    here = facts.where(F.col("kind") == "value").join(links, "metric")
    num = F.col("value_num").isNotNull()
    n_sources = facts.where(F.col("kind") == "source").join(links, "metric").groupBy(*by).agg(F.countDistinct("source_citation").alias("n_sources"))
    rank = F.struct(F.col("best.tier_rank"), -F.col("value_num"), F.col("best._ord"))
    sums = here.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(num, F.col("n"))), F.lit(0)).alias("n_with_value"),
        F.min(F.when(num, F.struct(rank.alias("r"), "value_num", F.col("best.source_citation")))).alias("best"), F.min("first").alias("first"),
        F.min("value_num").alias("range_min"), F.max("value_num").alias("range_max"), F.max(F.col("own") & F.col("high")).alias("high"), F.max(num & F.col("gold")).alias("gold"),
    )
    counts = here.where(num).select(*by, "value_num", "n")
    agreed = agreement(counts, by, "value_num", "n", agreement_pct, most=facts.count())  # a group has each fact once at most
    both = sums.join(F.broadcast(n_sources), by).join(F.broadcast(agreed), by, "left")  # a row for each required metric and kind of id
    fields = [c for c in both.columns if c not in by]
    chosen = both.groupBy("metric_id").agg(F.max_by(F.struct(*fields), F.col("own")).alias("s")).select("metric_id", "s.*")
    out = F.broadcast(required).join(chosen, "metric_id", "left")
    single = F.col("n_all") < 2
    agrees = single | (F.col("n_agree") == F.col("n_all"))
    away = F.col("n_all") - F.col("n_agree")
    text = F.when(single, F.concat(F.col("n_all").cast("string"), F.lit(" source(s)"))).otherwise(
        F.concat(F.col("n_agree").cast("string"), F.lit(" of "), F.col("n_all").cast("string"), F.lit(" agree"), F.when(away > 0, F.concat(F.lit("; "), away.cast("string"), F.lit(" outlier(s)"))).otherwise(""))
    )
    flag = F.when(F.col("n_sources").isNull(), "no data").when(F.col("n_with_value") == 0, "no numeric values").otherwise(text)
    status = F.when(F.coalesce("n_sources", F.lit(0)) == 0, "No source").when((F.col("n_with_value") > 0) & agrees & (F.col("high") | F.col("gold")), "Ready").otherwise("Needs review")
    return out.select(
        "metric_id", "label", "required", F.col("best.value_num").alias("best_value"), F.coalesce("best.source_citation", "first.source_citation").alias("best_source"), "range_min", "range_max",
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("n_with_value", F.lit(0)).alias("n_with_value"), flag.alias("agreement_flag"), status.alias("validation_status"),
    )


def first_joined(names: Column, most: int, length: int) -> Column:
    return F.left(F.array_join(F.slice(F.array_sort(names), 1, most), "; "), F.lit(length))


def coverage(evidence: DataFrame, required: DataFrame) -> DataFrame:
    """One row per required metric: sources, valued rows, stubs, the first ten sources with a value, and a status. Evidence ids don't count here.

    Source names are made distinct before they are listed, so that lists have one entry for each source.
    """
    rows = evidence.join(F.broadcast(required.select("metric_id")), F.col("metric") == F.col("metric_id"), "left_semi").withColumn("stub", X.is_stub("value"))
    by_source = rows.groupBy("metric", "source_citation").agg(F.count_if(~F.col("stub")).alias("good"), F.count_if(F.col("stub") & F.col("value").isNotNull()).alias("bad"), F.count(F.when(~F.col("stub"), 1)).alias("seen"))
    names = F.collect_list(F.when((F.col("seen") > 0) & F.col("source_citation").isNotNull(), F.col("source_citation")))
    sums = by_source.groupBy("metric").agg(F.count("source_citation").alias("n_sources"), F.sum("good").alias("n_with_value"), F.sum("bad").alias("n_stub"), names.alias("names"))
    joined = F.broadcast(required).join(sums, required["metric_id"] == sums["metric"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(n("n_with_value") > 0, "Has value").when((n("n_stub") > 0) | (n("n_sources") > 0), "Stub only").otherwise("Missing")
    return joined.select("metric_id", "label", n("n_sources").alias("n_sources"), n("n_with_value").alias("n_with_value"), n("n_stub").alias("n_stub"), F.coalesce(first_joined(F.col("names"), 10, 500), F.lit("")).alias("source_list"), status.alias("coverage_status"))


def white_space_counts(covered: DataFrame) -> DataFrame:
    return covered.groupBy("coverage_status").agg(F.count("*").alias("n_metrics"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """Groups of metric, year and population with different texts as values: the first two, with the first two rows' sources.

    Rows without metric are left out; blank years and populations are groups too. Values are made distinct before they
    are ordered, and of the rows only the first two of each group are shuffled: Spark cuts a ranked window before its
    exchange. The few columns of use are stored, so evidence is read once.
    """
    keys = ["metric", "year_or_range", "population"]
    text = F.trim(F.coalesce("value", F.lit("")))
    rows = evidence.where(F.col("metric").isNotNull()).select("_ord", "source_citation", "metric", *[F.coalesce(c, F.lit("")).alias(c) for c in keys[1:]], text.alias("v")).where(F.col("v") != "")
    rows = stored(rows, "values")
    group = Window.partitionBy(*keys)
    values = rows.groupBy(*keys, "v").agg(F.min("_ord").alias("at"), F.count("*").alias("n"))
    ranked = values.select("*", F.row_number().over(group.orderBy("at", "v")).alias("k"), F.count("*").over(group).alias("n_values"))
    nth = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    two = ranked.where((F.col("k") <= 2) & (F.col("n_values") >= 2)).groupBy(*keys).agg(nth(1, "v").alias("value_1"), nth(2, "v").alias("value_2"), F.max("n_values").alias("n_values"))
    first = rows.select(*keys, "source_citation", F.row_number().over(group.orderBy("_ord", "source_citation")).alias("k")).where(F.col("k") <= 2)
    sources = first.groupBy(*keys).agg(nth(1, "source_citation").alias("source_1"), nth(2, "source_citation").alias("source_2"))
    return two.join(sources, keys).select(*keys, "value_1", "value_2", "source_1", "source_2", "n_values")


def reconciliation(evidence: DataFrame, required: DataFrame, listed: int = 125, length: int = 1000) -> DataFrame:
    """Groups of a required metric, year and geography whose numbers differ by their fourth decimal: range, list, recommendation.

    The list shows the first rows by _ord up to `length` characters (an entry takes eight at least, so `listed` rows fill it); the recommended row is the first of the best tier.
    The few columns of use are stored, so evidence is read once.
    """
    keys = ["metric", "year_or_range", "geography"]
    rows = evidence.where(F.col("value_num").isNotNull()).join(F.broadcast(required.select("metric_id", "label")), F.col("metric") == F.col("metric_id"))
    rows = rows.select("_ord", "label", "metric", *[F.coalesce(c, F.lit("")).alias(c) for c in keys[1:]], "source_citation", "tier_rank", "value_num")
    rows = stored(rows, "numbers")
    best = F.min(F.struct("tier_rank", "_ord", "value_num", "source_citation"))
    sums = rows.groupBy(*keys, "label").agg(F.count("*").alias("n_rows"), F.countDistinct(F.round("value_num", 4)).alias("kinds"), F.min("value_num").alias("range_min"), F.max("value_num").alias("range_max"), best.alias("b"))
    sums = sums.where((F.col("n_rows") >= 2) & (F.col("kinds") >= 2))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_ord", "source_citation", "value_num"))
    shown = rows.withColumn("nth", nth).where(F.col("nth") <= listed).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", "source_citation", "value_num"))).alias("items"))
    item = lambda x: F.concat(x["source_citation"], F.lit(": "), F.format_number(x["value_num"], 2))
    out = sums.join(shown, keys)
    return out.select(
        F.col("metric").alias("metric_id"), "label", "year_or_range", "geography", F.left(F.array_join(F.transform("items", item), "; "), F.lit(length)).alias("value_by_source"), "range_min", "range_max",
        F.col("b.value_num").alias("recommended_value"), F.col("b.source_citation").alias("recommended_source"), "n_rows",
    )
