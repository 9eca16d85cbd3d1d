"""Data-quality findings: level, code, message, n_rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.evidence import REQUIRED

LEVELS = ("error", "warning", "info")


def _finding(level: str, code: str, message, n, when):
    m = message if not isinstance(message, str) else F.lit(message)
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), m.alias("message"), n.cast("long").alias("n_rows")))


def validate_evidence(df: DataFrame) -> DataFrame:
    """All findings from one pass of sums, and one aggregation by key for repeated keys.

    Missing columns and unknown tiers are errors; an empty table, blanks in required columns and repeated keys warnings.
    """
    spark = df.sparkSession
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return spark.createDataFrame([("error", "missing_columns", "missing: " + ", ".join(missing), 0)], "level string, code string, message string, n_rows long")
    tier = F.coalesce(X.key("source_tier"), F.lit(""))
    bad = ~tier.isin(*X.TIERS)
    sums = df.agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.array_join(F.array_sort(F.collect_set(F.when(bad & (tier != ""), tier))), ", ").alias("tiers"),
        *[F.count_if(X.is_blank(c)).alias(f"blank_{c}") for c in ("metric", "value", "source_citation")],
    )
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("metric", "year_or_range", "geography") if c in df.columns]
    twice = df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("repeated"))
    n = F.col("n")
    found = F.array_compact(F.array(
        _finding("warning", "empty", "no rows", n, n == 0),
        _finding("error", "invalid_tier", F.concat(F.lit("unknown tiers: "), F.col("tiers")), F.col("bad"), F.col("bad") > 0),
        *[_finding("warning", f"blank_{c}", f"blank {c}", F.col(f"blank_{c}"), F.col(f"blank_{c}") > 0) for c in ("metric", "value", "source_citation")],
    ))
    first = sums.select(F.inline(found))
    second = twice.where(F.col("repeated") > 0).select(F.lit("warning").alias("level"), F.lit("repeated_key").alias("code"), F.lit("repeated metric, year and geography").alias("message"), F.col("repeated").alias("n_rows"))
    return first.unionByName(second)


def validate_output(df: DataFrame, required: list[str], column: str = "cluster", most: float = 0.2) -> DataFrame:
    """Missing columns are an error, a column that is null in over `most` of the rows a warning, else there is an info row."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    if missing:
        return spark.createDataFrame([("error", "missing_columns", "missing: " + ", ".join(missing), 0)], "level string, code string, message string, n_rows long")
    empty = F.col(column).isNull() | (F.col(column) == "unknown")
    sums = df.agg(F.count("*").alias("n"), F.count_if(empty).alias("k"))
    many = F.coalesce(F.col("k") / F.when(F.col("n") > 0, F.col("n")) > most, F.lit(False))
    return sums.select(F.when(many, "warning").otherwise("info").alias("level"), F.when(many, f"{column}_nulls").otherwise("ok").alias("code"), F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(f" rows without {column}")).alias("message"), F.col("k").alias("n_rows"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_rows, filled (percent, one decimal), in one pass."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(~X.is_blank(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.round(100 * F.col(c) / F.when(F.col("n") > 0, F.col("n")), 1).alias("filled")) for c in columns])
    return sums.select(F.inline(rows))


def ensure(findings: DataFrame) -> None:
    """Strict mode: raises if there is an error."""
    errors = findings.where(F.col("level") == "error").select("code", "message").limit(20).collect()
    if errors:
        raise ValueError("; ".join(f"{c}: {m}" for c, m in errors))


def validate_file(spark, path: str, read) -> DataFrame:
    """validate_evidence() of a file; one that can't be read gives an error row."""
    from pyspark.errors import PySparkException

    try:
        return validate_evidence(read(spark, path))
    except PySparkException as e:
        return spark.createDataFrame([("error", "file_missing" if "PATH_NOT_FOUND" in str(e) else "file_unreadable", path, 0)], "level string, code string, message string, n_rows long")
