"""Tidy rows, the wide table by year, and growth forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored


def tidy(evidence: DataFrame, scenario: str = "Base", growth: str = "") -> DataFrame:
    """One tidy row per evidence row, with the strict year, and split type `stage` only where a split is given."""
    return evidence.select(
        "_ord", "indication", "metric", "value", X.strict_year("year_or_range").cast("long").alias("year"), F.col("source_citation").alias("source"),
        F.when(~X.is_blank("split_logic"), "stage").alias("split_type"), X.blank_to_null("split_logic").alias("split_value"), F.lit(scenario).alias("scenario_label"), F.lit(growth).alias("growth_label"),
    )


def wide(rows: DataFrame, years: list[int]) -> DataFrame:
    """Parameter by year: the first value by _ord in each cell, rows numbered by parameter. Years are given, so that no job has to find them.

    The parameter is the split, or else the metric. Rows without a year drop out.
    """
    cells = rows.where(F.col("year").isNotNull()).withColumn("parameter", F.coalesce("split_value", "metric")).groupBy("parameter").pivot("year", years)
    table = cells.agg(F.min(F.when(F.col("value").isNotNull(), F.struct("_ord", "value"))).getField("value"))
    return table.select(F.row_number().over(Window.orderBy("parameter")).cast("long").alias("sr_no"), "parameter", *[F.col(str(y)).alias(f"y{y}") for y in years])


def one_column(rows: DataFrame) -> DataFrame:
    """Without any year: each parameter's first value."""
    return rows.withColumn("parameter", F.coalesce("split_value", "metric")).groupBy("parameter").agg(F.min(F.struct("_ord", "value")).getField("value").alias("value"))


def trend(rows: DataFrame, horizon: int = 5, rates: DataFrame | None = None, rate: float | None = None) -> DataFrame:
    """metric, year, forecast, growth: compound growth from each metric's last year.

    Rows need a strict year and a plain number. Growth is the given rate, else that between the last two rows where the
    years differ and the former value is positive, else 0. The value that grows is the first row's of the last year.
    Two rounds of maxima find those rows, so no metric's rows are sorted or collected; the points are stored, so
    evidence is read once.
    """
    points = rows.select("metric", "_ord", X.strict_year("year_or_range").alias("y"), X.plain_number("value").alias("v")).where(F.col("y").isNotNull() & F.col("v").isNotNull())
    points = stored(points, "points")
    at = F.struct("y", "_ord", "v").alias("p")
    last = points.groupBy("metric").agg(F.max(at).alias("p2"), F.max("y").alias("last_year"))
    joined = points.join(last, "metric")
    before = joined.where(F.struct("y", "_ord", "v") < F.col("p2")).groupBy("metric").agg(F.max(at).alias("p1"))
    start = joined.where(F.col("y") == F.col("last_year")).groupBy("metric").agg(F.min(F.struct("_ord", "v")).getField("v").alias("last_value"))
    both = last.join(start, "metric").join(before, "metric", "left")
    years, ratio = F.col("p2.y") - F.col("p1.y"), F.col("p2.v") / F.when(F.col("p1.v") > 0, F.col("p1.v"))
    auto = F.coalesce(F.when((years > 0) & (F.col("p1.v") > 0), F.pow(ratio, 1.0 / F.when(years > 0, years)) - 1), F.lit(0.0))
    if rates is not None:
        both = both.join(F.broadcast(rates.select("metric", F.col("rate").alias("_rate"))), "metric", "left")
        auto = F.coalesce("_rate", auto)
    growth = F.lit(rate) if rate is not None else auto
    steps = both.select("metric", "last_year", "last_value", growth.alias("g"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("metric", (F.col("last_year") + F.col("h")).cast("long").alias("year"), F.round(F.col("last_value") * F.pow(1 + F.col("g"), F.col("h")), 2).alias("forecast"), F.round("g", 6).alias("growth"))


def scenarios(rows: DataFrame, options: list[tuple[str, str, float]], horizon: int = 5) -> DataFrame:
    """trend() once per scenario, with the scenario's rate. The scan and the search for last rows are shared."""
    base = trend(rows, 1, rate=0.0).select("metric", F.col("forecast").alias("last_value"), (F.col("year") - 1).alias("last_year"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r).alias("r")) for i, _, r in options])).alias("s")
    steps = base.select("metric", "last_value", "last_year", every).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("metric", F.col("s.id").alias("scenario"), (F.col("last_year") + F.col("h")).alias("year"), F.round(F.col("last_value") * F.pow(1 + F.col("s.r"), F.col("h")), 2).alias("forecast"))
