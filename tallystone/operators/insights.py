"""Summaries: insights by metric, clusters, URL coverage, distributions, top sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def insights(evidence: DataFrame, card: DataFrame | None = None, n_values: str | None = None) -> DataFrame:
    """Per metric: values, tiers, first and last year, whether the scorecard has no source for it, and a sentence. n_values names the count where values are counted already."""
    y = X.strict_year("year_or_range")
    out = evidence.groupBy("metric").agg(
        (F.sum(n_values) if n_values else F.count("value")).alias("n_values"), F.array_join(F.array_sort(F.collect_set(X.key("source_tier"))), ", ").alias("tiers"), F.min(y).cast("long").alias("min_year"), F.max(y).cast("long").alias("max_year")
    )
    gaps = card.where(F.col("validation_status") == "No source").select(F.col("metric_id").alias("metric"), F.lit(True).alias("_gap")) if card is not None else None
    out = out.join(F.broadcast(gaps), "metric", "left").withColumn("has_gap", F.coalesce("_gap", F.lit(False))).drop("_gap") if gaps is not None else out.withColumn("has_gap", F.lit(False))
    years = F.when(F.col("min_year").isNull(), "").when(F.col("min_year") == F.col("max_year"), F.concat(F.lit(" for "), F.col("min_year").cast("string"))).otherwise(F.concat(F.lit(" for "), F.col("min_year").cast("string"), F.lit(" to "), F.col("max_year").cast("string")))
    return out.withColumn("insight", F.concat(F.col("metric"), F.lit(": "), F.col("n_values").cast("string"), F.lit(" value(s)"), years, F.lit(" from "), F.col("tiers"), F.when(F.col("has_gap"), " (gap)").otherwise("")))


def share_of(df: DataFrame, by: str, within: str) -> DataFrame:
    """Counts by two columns and each count's percentage of the outer one's total."""
    counts = df.groupBy(within, by).agg(F.count("*").alias("n_rows"))
    return counts.withColumn("pct", F.round(100 * F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(within)), 1))


def cluster_summary(evidence: DataFrame) -> DataFrame:
    return share_of(evidence, "cluster", "indication")


def url_coverage(evidence: DataFrame) -> DataFrame:
    n = F.count_if(X.is_blank("source_url"))
    return evidence.groupBy("indication").agg(F.count("*").alias("n_rows"), n.alias("n_without"), F.round(100 * n / F.count("*"), 1).alias("pct_without"))


def _rows(n_rows: str | None):
    return (F.sum(n_rows) if n_rows else F.count("*")).alias("n_rows")


def distribution(evidence: DataFrame, column: str, n_rows: str | None = None) -> DataFrame:
    """Rows by a column's value; n_rows names the count where rows are counted already."""
    return evidence.groupBy(F.coalesce(X.key(column), F.lit("")).alias(column)).agg(_rows(n_rows))


def top_sources(evidence: DataFrame, n: int = 5, n_rows: str | None = None) -> DataFrame:
    """The n sources with most rows; ties by name."""
    return evidence.where(F.col("source_citation").isNotNull()).groupBy("source_citation").agg(_rows(n_rows)).orderBy(F.desc("n_rows"), "source_citation").limit(n)


def best_of(df: DataFrame, by: str, count: str, label: str) -> DataFrame:
    """Of several phrasings the one with the highest count; ties by label."""
    best = F.max_by(F.col(label), F.struct(F.col(count), F.col(label)))
    return df.groupBy(by).agg(F.max(count).alias("best_count"), best.alias("best_label"), F.count("*").alias("n_tried"))


def best_with_notes(df: DataFrame, by: str, phrase: str, count: str, order: str, listed: int = 4, cut: int = 48, length: int = 900) -> DataFrame:
    """by, best_count, best_label, n_tried, notes of several phrasings of each subject: the highest count, and the first counts in the order of trial.

    A phrasing without count has failed: it is tried, but not listed. Of equal counts the first tried is best; without any above 0 there is
    none. A subject's phrasings are those that a rule lists, so their few entries are ordered within one aggregate.
    """
    got = F.col(count).isNotNull()
    entry = F.struct(F.col(order).alias("o"), F.concat(F.left(phrase, F.lit(cut)), F.lit(": "), F.col(count).cast("string")).alias("t"))
    best = F.min(F.when(F.col(count) > 0, F.struct((-F.col(count)).alias("n"), F.col(order).alias("o"), F.col(phrase).alias("p"))))
    sums = df.groupBy(by).agg(F.coalesce(F.max(count), F.lit(0)).cast("long").alias("best_count"), best.alias("b"), F.count("*").alias("n_tried"), F.array_sort(F.collect_list(F.when(got, entry))).alias("es"))
    head = F.concat(F.col("best_count").cast("string"), F.lit(" found (best of "), F.col("n_tried").cast("string"), F.lit(" phrasings). "))
    notes = F.left(F.concat(head, F.array_join(F.transform(F.slice("es", 1, listed), lambda e: e["t"]), "; ")), F.lit(length))
    return sums.select(by, "best_count", F.col("b.p").alias("best_label"), "n_tried", notes.alias("notes"))
