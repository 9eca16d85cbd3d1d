"""Sinks: partitioned tables, ordered CSV, manifest, data dictionary, run metadata, stale partitions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, run_keys: list[str] | None = None, fmt: str = "parquet") -> None:
    """Writes a table. With run keys only the partitions that df has are replaced, so one run can't delete another's rows."""
    w = df.write.mode("overwrite").format(fmt)
    if run_keys:
        w = w.partitionBy(*run_keys).option("partitionOverwriteMode", "dynamic")
    (w.option("header", True) if fmt == "csv" else w).save(path)


def write_by_metric(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV files ordered by metric over all of them: a range sort, without pulling everything into one task."""
    df.orderBy("metric", "_ord").write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def out_of_order(rows: DataFrame, file: str, key: list[str]) -> DataFrame:
    """The rows' first key column, and wrong: whether a row's key is less than that of the row before it in its file.

    Rows must come as their files are read, each file by one task, as compressed files are; so nothing is shuffled. Keys are texts,
    compared by bytes; a null counts as the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the zero byte ends a column's text, so that texts compare column by column
            joined = pc.binary_join_element_wise(*[batch.column(i + 1).fill_null("") for i in range(len(key))], "\x00")
            now = pa.table({"f": batch.column(0), "k": joined})
            both = pa.concat_tables([now.slice(0, 1) if last is None else last, now]).combine_chunks()
            before, after = both.slice(0, batch.num_rows), both.slice(1)
            wrong = pc.and_(pc.equal(before["f"], after["f"]), pc.greater(before["k"], after["k"])).combine_chunks()
            last = now.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), wrong], names=[key[0], "wrong"])

    return rows.select(file, *key).mapInArrow(run, f"{key[0]} string, wrong boolean")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_columns, columns of the tables; counts are one job each branch of a union."""
    one = lambda name, df: df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(", ".join(df.columns)).alias("columns"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in tables.items()])


def data_dictionary(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, position, column_name, data_type: from the schemas alone."""
    rows = [(name, i, c, k) for name, df in tables.items() for i, (c, k) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position long, column_name string, data_type string")


def checksums(df: DataFrame, by: str) -> DataFrame:
    """by, n_rows, checksum: 16 digits of the SHA-256 of each group's summed row hashes, whatever the row order.

    Only a count and two sums for each group are shuffled.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)"))
    sums = df.groupBy(by).agg(F.count("*").alias("n_rows"), part(1).alias("_a"), part(13).alias("_b"))
    return sums.select(by, "n_rows", F.left(F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string")), 256), F.lit(16)).alias("checksum"))


def run_manifest(df: DataFrame, by: str, as_of: str) -> str:
    """checksums() as JSON: one entry a run."""
    return json.dumps({"as_of": as_of, "runs": [r.asDict() for r in checksums(df, by).orderBy(by).collect()]})


def source_log(*parts: DataFrame) -> DataFrame:
    """Logs of differing columns as one: the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stale(existing: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions on disk that the current run doesn't write, by equal keys, not by parts of names."""
    return existing.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")
