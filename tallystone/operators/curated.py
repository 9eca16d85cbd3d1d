"""Curated entries and write-back: upserts, prioritised lookups, change logs, refreshes of projected sheets, trend tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, change: new values win; change is added, updated or kept."""
    n, o = new.select(F.col(key).alias("_k"), F.col(value).alias("_n"), F.lit(True).alias("_is")), old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_was"))
    both = o.join(n, o[key] == n["_k"], "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNotNull() & ~F.col("_n").eqNullSafe(F.col("_o")), "updated").otherwise("kept")
    return both.select(F.coalesce(key, "_k").alias(key), F.when(F.col("_is").isNotNull(), F.col("_n")).otherwise(F.col("_o")).alias(value), change.alias("change"))


def write_back(cells: DataFrame, values: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """cell, old, new, source: cells whose value by excel id, or else by metric id, differs by more than the tolerance.

    cells: cell, excel_id, metric_id, old; values: id, value, source.
    """
    first = values.select(F.col("id").alias("_i1"), F.col("value").alias("_v1"), F.col("source").alias("_s1"))
    second = values.select(F.col("id").alias("_i2"), F.col("value").alias("_v2"), F.col("source").alias("_s2"))
    both = cells.join(first, cells["excel_id"] == F.col("_i1"), "left").join(second, cells["metric_id"] == F.col("_i2"), "left")
    new = X.same_percent(F.coalesce("_v1", "_v2"), "old")
    both = both.select("cell", "old", new.alias("new"), F.when(F.col("_v1").isNotNull(), F.col("_s1")).otherwise(F.col("_s2")).alias("source"))
    away = F.abs(F.col("new") - F.col("old")) / F.greatest(F.abs("old"), F.lit(1e-6))
    return both.where(F.col("new").isNotNull() & (F.col("old").isNull() | (away > tolerance)))


def preferred(values: DataFrame, order: list[str], key: str = "metric_id", value: str = "value") -> DataFrame:
    """The value of the first id in the order that has one."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(key))
    return values.where((place > 0) & F.col(value).isNotNull()).agg(F.min_by(key, place).alias(key), F.min_by(value, place).alias(value))


def refresh(df: DataFrame, columns: dict[str, list[str]], where=None) -> DataFrame:
    """Each output column is the first non-blank of its candidates that exist, else blank."""
    rows = df.where(where) if where is not None else df
    pick = lambda names: F.coalesce(*[X.blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns], F.lit(""))
    return rows.select(*[pick(names).alias(c) for c, names in columns.items()])


def trend_table(df: DataFrame, key: str, value: str, kinds: list[str]) -> DataFrame:
    """Keys such as `rate_2001` as one row for each year and a column for each kind, the largest value where keys repeat."""
    kind, year = F.regexp_extract(key, r"^(.*)_(\d{4})$", 1), F.regexp_extract(key, r"^(.*)_(\d{4})$", 2)
    rows = df.select(kind.alias("kind"), year.alias("year"), value).where(F.col("year") != "")
    return rows.groupBy(F.col("year").cast("long").alias("year")).pivot("kind", kinds).agg(F.max(value))


def registry_rows(cells: DataFrame, value_columns: list[int], row: str = "cells") -> DataFrame:
    """key, value from table rows: the first cell, and the first usable one of value_columns (0-based)."""
    cell = lambda i: X.clean_cell(F.get(row, F.lit(i)))
    value = F.coalesce(*[cell(i) for i in value_columns]).try_cast("double")
    return cells.select(cell(0).alias("key"), value.alias("value")).where(F.col("key").isNotNull() & F.col("value").isNotNull())


def renamed(df: DataFrame, names: dict[str, str], column: str) -> DataFrame:
    """Adds full_name: the mapped name, or the value itself."""
    mapped = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    return df.withColumn("full_name", F.coalesce(F.try_element_at(mapped, F.col(column)), F.col(column)))


def change_log(cells: DataFrame, values: DataFrame, labels: dict[str, str] | None = None, dry_run: bool = True, tolerance: float = 0.001) -> DataFrame:
    """metric_id, cell, old, new, source, confidence, status of every cell that a value changes.

    cells: cell, excel_id, metric_id, label, old; values: id, value, source, confidence. A cell takes the value of its
    excel id, else of its metric id, else of the metric that labels gives its label. Status is `dry_run` or `updated`;
    nothing is changed in place.
    """
    by_label = F.create_map(*[F.lit(x) for m, text in (labels or {}).items() for x in (text, m)]) if labels else F.create_map().cast("map<string,string>")
    ids = F.array_compact(F.array("excel_id", "metric_id", F.try_element_at(by_label, F.col("label"))))
    tries = cells.select("cell", "old", F.posexplode(ids).alias("nth", "id")).join(values, "id")
    best = tries.groupBy("cell", "old").agg(F.min(F.struct("nth", "id", "value", "source", "confidence")).alias("b"))
    log = best.select(F.col("b.id").alias("metric_id"), "cell", "old", X.same_percent("b.value", "old").alias("new"), F.col("b.source").alias("source"), F.coalesce("b.confidence", F.lit("")).alias("confidence"), F.lit("dry_run" if dry_run else "updated").alias("status"))
    away = F.abs(F.col("new") - F.col("old")) / F.greatest(F.abs("old"), F.lit(1e-6))
    return log.where(F.col("new").isNotNull() & (F.col("old").isNull() | (away > tolerance)))


def cascade(cells: DataFrame, values: DataFrame, options: dict[str, str], core: dict[str, int | str]) -> DataFrame:
    """step, cell, metric_id, old, new, source of the cells that values reach in three steps, each with its own lookup.

    cells: cell, row (their order), label, old; values: metric_id, label, value, source. `option`: a metric's value goes to the first row whose
    label is exactly the one that options give it. `core`: to the row that core gives its metric, by number or as the
    first of a label. `label`: a row takes the first value (by metric) whose label is its own, whatever the case. Values
    that are null reach nothing. A cell may be reached by several steps; the later ones overwrite, so all are listed.
    """
    given = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = lambda wanted: given.sparkSession.createDataFrame(wanted or [("", "")], "metric_id string, _label string").join(given, "metric_id")
    first = lambda df: df.groupBy("metric_id").agg(F.min(F.struct("row", "cell", "old", "value", "source")).alias("b")).select("metric_id", "b.*")
    by_label = lambda wanted: first(rows(wanted).join(cells.withColumnRenamed("label", "_label"), "_label"))
    numbers = given.sparkSession.createDataFrame([(m, n) for m, n in core.items() if isinstance(n, int)] or [("", -1)], "metric_id string, row long")
    by_number = numbers.join(given, "metric_id").join(cells.select(F.col("row").cast("long").alias("row"), "cell", "old"), "row").select("metric_id", "row", "cell", "old", "value", "source")
    firsts = given.where(F.trim("label") != "").groupBy(F.lower("label").alias("_key")).agg(F.min(F.struct("metric_id", "value", "source")).alias("b"))
    blind = cells.join(firsts, F.lower("label") == F.col("_key")).select("b.metric_id", "row", "cell", "old", "b.value", "b.source")
    steps = [("option", by_label(list(options.items()))), ("core", by_number.unionByName(by_label([(m, t) for m, t in core.items() if isinstance(t, str)]), allowMissingColumns=True)), ("label", blind)]
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("step"), "cell", "metric_id", "old", F.col("value").alias("new"), "source") for name, df in steps])
