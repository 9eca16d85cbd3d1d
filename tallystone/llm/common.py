"""Helpers shared by the training-data operators: shared-folder tables, row keys, text chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stored

#: ASCII white space only: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Writes a table to the shared folder and reads it back.
materialise = stored


def forget(spark: SparkSession) -> None:
    """Deletes what materialise() has written for this application, once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows; beyond that joins shuffle it."""
    return F.broadcast(df) if rows <= most else df


def fold(doc_id: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % buckets


def with_row_key(df: DataFrame, id_col: str, key: str = "_row") -> DataFrame:
    """Adds a unique long whose order is that of id_col.

    Where ids are unique and present (one count over the id column alone), that is the id itself. Otherwise rows are
    sorted by id (nulls last), then by their other columns' hash, numbered, and written to the shared folder.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    n, given, distinct = ids.agg(F.count("*"), F.count("i"), F.countDistinct("i")).first()
    if n == given == distinct:
        return df.withColumn(key, F.col(id_col).cast("long"))
    rest = [F.col(f"`{c}`").cast("string") for c in df.columns]
    ordered = df.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(*rest))
    return materialise(ordered.withColumn(key, F.monotonically_increasing_id()), "rows")


def masked(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named _c0, _c1 and so on, which no operator's own columns clash with, and those names."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def others(keep: Sequence[str], *made: str) -> list[str]:
    """keep without the names of columns that an operator makes itself: its own win where names clash."""
    return [c for c in keep if c not in made]


def chunks(sizes: Sequence[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about budget; a row larger than that is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_map(df: DataFrame, columns: list[str], text: str, schema: str, make, budget: int = 2_000_000) -> DataFrame:
    """Runs make(rows, texts) over whole texts in chunks of about `budget` bytes and returns its columns under schema.

    make gets a dict of pyarrow arrays (columns) and a list of str (nulls as None), and returns a list of arrays in
    the order of schema. Only columns and text leave the JVM.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = columns if text in columns else [*columns, text]
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(place)).fill_null(0).to_pylist()
            for a, b in chunks([n + 64 for n in sizes], budget):
                rows = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(columns)}
                made = make(rows, batch.column(place).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, type=f.type) for x, f in zip(made, arrow)],
                    schema=arrow,
                )

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
