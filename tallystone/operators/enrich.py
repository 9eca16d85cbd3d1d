"""Enrichment of evidence rows, in the fixed order: legacy confidence, URL, score, label, cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def add_urls(df: DataFrame, keys: list[tuple[str, str]], whole_words: bool = False) -> DataFrame:
    """Fills blank URLs from citations."""
    return df.withColumn("source_url", F.when(X.is_blank("source_url"), X.resolve_url("source_citation", keys, whole_words)).otherwise(F.col("source_url")))


def cluster_of(metric: Column | str, exact: dict[str, str], patterns: list[tuple[str, str]]) -> Column:
    """By the exact id, else by the id without its first prefix, else by the first pattern contained, else unknown.

    The taxonomy is a handful of rules, so it becomes part of the expression and needs no join.
    """
    m = X.key(metric)
    of = lambda c: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), exact.items(), F.when(F.lit(False), ""))
    bare = F.regexp_replace(m, "^[^_]*_", "")
    by_pattern = F.coalesce(*[F.when(F.contains(m, F.lit(p)), F.lit(c)) for p, c in patterns], F.lit("unknown"))
    return F.when(X.is_blank(metric), "unknown").otherwise(F.coalesce(of(m), of(bare), by_pattern))


def add_clusters(df: DataFrame, exact: dict[str, str], patterns: list[tuple[str, str]], labels: dict[str, str], overwrite: bool = False) -> DataFrame:
    found = cluster_of("metric", exact, patterns)
    if "cluster" in df.columns and not overwrite:
        found = F.coalesce(X.blank_to_null("cluster"), found)
    df = df.withColumn("cluster", found)
    label = reduce(lambda w, kv: w.when(F.col("cluster") == kv[0], kv[1]), labels.items(), F.when(F.lit(False), ""))
    return df.withColumn("cluster_label", F.coalesce(label, F.initcap(F.translate("cluster", "_", " "))))


def enrich(df: DataFrame, as_of: int, url_keys: list[tuple[str, str]], exact: dict[str, str], patterns: list[tuple[str, str]], labels: dict[str, str]) -> DataFrame:
    """All steps, in a single stage. The score asks whether there is a URL, and doesn't carry the expression that makes it."""
    linked = ~X.is_blank("source_url") | X.has_url("source_citation", url_keys)
    df = df.withColumn("computed_confidence_score", X.confidence_score(as_of, url=linked).cast("long"))
    df = df.withColumn("confidence", X.legacy_confidence("confidence"))
    df = add_urls(df, url_keys)
    df = df.withColumn("computed_confidence", X.confidence_label("computed_confidence_score"))
    df = add_clusters(df, exact, patterns, labels)
    return df.withColumn("value_num", X.first_number("value")).withColumn("tier_rank", X.tier_rank("source_tier"))
