"""Narratives as rows of section, ord and line; rendering collects the few lines last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def lines(df: DataFrame, section: str, order: list, line) -> DataFrame:
    n = F.row_number().over(Window.orderBy(*order)).cast("long")
    return df.select(F.lit(section).alias("section"), n.alias("ord"), line.alias("line"))


def sections(df: DataFrame, parts: list[tuple], order: str) -> DataFrame:
    """Lines of several sections from one pass: parts are (section, whether a row belongs, its line)."""
    every = F.array_compact(F.array(*[F.when(belongs, F.struct(F.lit(name).alias("section"), text.alias("line"))) for name, belongs, text in parts]))
    rows = df.select(F.col(order).alias("_o"), F.inline(every))
    return rows.select("section", F.row_number().over(Window.partitionBy("section").orderBy("_o")).cast("long").alias("ord"), "line")


def white_space(covered: DataFrame) -> DataFrame:
    """Lines for covered, stub-only and missing metrics. The input has a row for each required metric."""
    name = F.concat(F.lit("- "), F.col("label"), F.lit(" ("), F.col("metric_id"), F.lit(")"))
    n, status = F.col("n_sources").cast("string"), F.col("coverage_status")
    valued = F.concat(name, F.lit(": "), n, F.lit(" source(s), "), F.col("n_with_value").cast("string"), F.lit(" with value"))
    parts = [("Has value", valued), ("Stub only", F.concat(name, F.lit(": "), n, F.lit(" source(s), look up by hand"))), ("Missing", name)]
    return sections(covered, [(s, status == s, text) for s, text in parts], "metric_id")


def evidence_summary(card: DataFrame, mix: DataFrame, top: DataFrame) -> DataFrame:
    """Key numbers, confidence mix, top sources and caveats."""
    key = F.concat(F.col("label"), F.lit(": "), F.format_number("best_value", 2), F.lit(" ("), F.col("validation_status"), F.lit(")"))
    caveat = F.concat(F.col("label"), F.lit(": "), F.col("agreement_flag"))
    of_card = sections(card, [("key numbers", F.col("best_value").isNotNull(), key), ("caveats", F.col("validation_status") != "Ready", caveat)], "metric_id")
    confidence = lines(mix.where(F.col("computed_confidence") != ""), "confidence", [F.desc("n_rows"), "computed_confidence"], F.concat(F.initcap("computed_confidence"), F.lit(": "), F.col("n_rows").cast("string"), F.lit(" row(s)")))
    sources = lines(top, "top sources", [F.desc("n_rows"), "source_citation"], F.concat(F.col("source_citation"), F.lit(": "), F.col("n_rows").cast("string"), F.lit(" row(s)")))
    return of_card.unionByName(confidence).unionByName(sources)


def rubric(mix: DataFrame) -> DataFrame:
    """How confidence is scored, from the weights in use, and what each label means, with its number of rows. mix: computed_confidence, n_rows."""
    spark = mix.sparkSession
    tiers = ", ".join(f"{t} {n}" for t, n in X.TIER_SCORES.items())
    factors = [
        f"Source tier: up to {max(X.TIER_SCORES.values())} points ({tiers}, others {X.TIER_DEFAULT})", f"Extraction: {X.EXTRACTED} points for a value, none for a link",
        f"Completeness: {X.CONTEXT_FIELD} points each for definition, year, geography and population", f"Recency: {X.RECENT} points within a year, {X.RECENT_ENOUGH} within five", f"URL: {X.WITH_URL} points",
    ]
    fixed = spark.createDataFrame([("factors", i + 1, t) for i, t in enumerate(factors)], "section string, ord long, line string")
    edges = [("high", X.HIGH, 100), ("medium", X.MEDIUM, X.HIGH - 1), ("low", 0, X.MEDIUM - 1)]
    labels = spark.createDataFrame([(name, i + 1, f"{low} to {high}: {name}") for i, (name, low, high) in enumerate(edges)], "name string, ord long, text string")
    counted = labels.join(mix, labels["name"] == mix["computed_confidence"], "left")
    return fixed.unionByName(counted.select(F.lit("labels").alias("section"), "ord", F.concat("text", F.lit(", "), F.coalesce("n_rows", F.lit(0)).cast("string"), F.lit(" row(s)")).alias("line")))


def render(report: DataFrame, title: str) -> str:
    """The report as Markdown."""
    out, last = [f"# {title}"], None
    for section, _, line in report.orderBy("section", "ord").collect():
        if section != last:
            out += ["", f"## {section.capitalize()}", ""]
            last = section
        out.append(line if line.startswith("- ") else f"- {line}")
    return "\n".join(out)
