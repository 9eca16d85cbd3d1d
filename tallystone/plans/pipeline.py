"""The evidence pipeline: one run over a configuration gives all derived tables, lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build, enrich, evaluate, insights, quality, report, sinks
from ..sources import evidence as E


@dataclass
class Config:
    """Settings of a run. Nothing is read from the clock: as_of gives the year."""

    as_of: int
    metrics: list[tuple]
    url_keys: list[tuple[str, str]] = field(default_factory=list)
    clusters: dict[str, str] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    labels: dict[str, str] = field(default_factory=dict)
    years: list[int] = field(default_factory=list)
    source: str = "upload"
    geography: str | None = None
    strict: bool = False
    keep_links: bool = False
    growth: dict[str, float] = field(default_factory=dict)


@dataclass
class Result:
    """The derived tables by name; enriched evidence stays persisted until close()."""

    tables: dict[str, DataFrame]
    findings: DataFrame
    held: DataFrame

    def write(self, path: str, run_keys: dict[str, str] | None = None) -> None:
        """Writes each table as Parquet under its name, with the manifest and the dictionary. Run keys become partitions, and only theirs are replaced."""
        keys = run_keys or {}
        for name, df in self.tables.items():
            sinks.write_table(df.withColumns({k: F.lit(v) for k, v in keys.items()}) if keys else df, f"{path}/{name}", list(keys))
        sinks.write_table(sinks.manifest(self.tables), f"{path}/manifest")
        sinks.write_table(sinks.data_dictionary(self.held.sparkSession, self.tables), f"{path}/data_dictionary")

    def close(self) -> None:
        self.held.unpersist()


def run(spark: SparkSession, rows: DataFrame | list[tuple[str, DataFrame]], config: Config) -> Result:
    """Rows may be one table, or several with their names, which are united in the order of tiers. Routes, filters, validates, enriches and evaluates evidence rows.

    Conflicts, tidy rows and forecasts see the rows before enrichment. In strict mode errors stop the run. The enriched
    rows feed most tables, so they are persisted once, on disk where memory is short.
    """
    if isinstance(rows, list):
        rows = E.union_by_tier(rows)[0].drop("tier", "tier_order", "source_name", "_at")
    kept, log = E.route_tiers(rows)
    base = E.keep_informative(E.for_run(kept, config.source, config.geography), config.keep_links)
    findings = quality.validate_evidence(base)
    if config.strict:
        quality.ensure(findings)
    full = enrich.enrich(base, config.as_of, config.url_keys, config.clusters, config.patterns, config.labels).persist(StorageLevel.MEMORY_AND_DISK)
    required = E.metrics_dim(spark, config.metrics)
    card = evaluate.scorecard(full, required)
    covered = evaluate.coverage(full, required)
    tidy = build.tidy(base)
    rates = spark.createDataFrame(list(config.growth.items()), "metric string, rate double") if config.growth else None
    tables = {
        "evidence": full,
        "source_log": log,
        "kpi_scorecard": card,
        "coverage": covered,
        "conflicts": evaluate.conflicts(base),
        "reconciliation": evaluate.reconciliation(full, required),
        "tidy": tidy,
        "wide": build.wide(tidy, config.years) if config.years else build.one_column(tidy),
        "forecast": build.trend(base, rates=rates),
        "insights": insights.insights(full, card),
        "clusters": insights.cluster_summary(full),
        "url_coverage": insights.url_coverage(full),
        "white_space": report.white_space(covered),
        "summary": report.evidence_summary(card, insights.distribution(full, "computed_confidence"), insights.top_sources(full)),
    }
    return Result(tables, findings, full)
