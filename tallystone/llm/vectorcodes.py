"""Vector code compression: product codes whose codebooks are learnt by Lloyd rounds over active entries alone.

Components become integers floor(256 * x), so distances and means are exact and no result depends on the partitions. A
vector is cut into equal parts; each part's code is its nearest entry of that part's codebook. After a round only some
entries have moved. A part whose own entry stayed keeps its stored distance, which still is the least among the entries
that stayed; so it is compared with the moved entries alone. Parts whose entry moved are compared with all.

Rows stay where they are: tasks send sums for each part and entry, and only codebooks (parts x entries, a parameter)
pass through the driver.

Rows whose vector is null or holds a null, NaN or infinite component are dropped. Vectors shorter than the longest kept one, or than
a multiple of the number of parts, end in zeros. Components beyond ±2**26 (of the integers) count as that, so that a vector's
error fits a long for up to 500 components. Repeated ids are rows like any others; null ids come last; equal ids are ordered by vector.
With fewer kept rows than entries, codebooks have as many entries as there are rows. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, small

SCALE, LIMIT = 256, 1 << 26
#: Rows whose distances are computed at once.
STEP = 2048
#: Labels are broadcast with their errors where there are no more than this.
MOST_BROADCAST = 100_000


def usable(vector: str) -> Column:
    x = F.col(f"`{vector}`")
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integers(vectors: pa.Array, parts: int, size: int) -> np.ndarray:
    """Vectors as whole numbers, cut into parts of `size` components: rows x parts x size."""
    n = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(n), parts * size), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.clip(flat, -LIMIT, LIMIT)
    return out.reshape(len(n), parts, size)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry (the first of equals) and the squared distance."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(0, len(x), STEP):
        d = ((x[i : i + STEP, None, :] - entries) ** 2).sum(2)
        code[i : i + STEP] = d.argmin(1)
        far[i : i + STEP] = d.min(1)
    return code, far


def reassign(x: np.ndarray, code: np.ndarray, far: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() for one part, from the assignment to the entries as they were. moved: which entries have changed since."""
    if not moved.any():
        return code, far
    code, far = code.copy(), far.copy()
    again = moved[code]
    code[again], far[again] = nearest(x[again], entries)
    rest, active = np.flatnonzero(~again), np.flatnonzero(moved)
    new, d = nearest(x[rest], entries[active])
    new = active[new]
    better = (d < far[rest]) | ((d == far[rest]) & (new < code[rest]))
    code[rest[better]], far[rest[better]] = new[better], d[better]
    return code, far


def _start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The first codebooks, parts x entries x size, from the rows of the least ids: `entries` rows reach the driver."""
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 1), np.int64)
    first = [r.v for r in rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    return integers(pa.array(first, pa.list_(pa.float64())), parts, max(1, -(-longest // parts))).transpose(1, 0, 2).copy()


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows with codes and distances. moved is None for the first round, whose rows have raw vectors; later rows have whole numbers and an assignment."""
    parts, _, size = books.shape
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("v", "code", "far")]])
    grid = lambda a, *shape: a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), *shape)
    lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), a[0].size).cast(pa.list_(pa.int64()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            if moved is None:
                x = integers(v, parts, size)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
            else:
                x, code, far = grid(v, parts, size), grid(batch.column("code"), parts), grid(batch.column("far"), parts)
                found = [reassign(x[:, p], code[:, p], far[:, p], books[p], moved[p]) for p in range(parts)]
            code, far = (np.stack([f[i] for f in found], 1) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists(x), lists(code), lists(far)], names=["id", "label", "v", "code", "far"])

    return rows.mapInArrow(run, schema)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each used entry becomes its parts' mean, componentwise and rounded down."""
    parts, entries, size = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, size)
                code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                place = np.broadcast_to(np.arange(parts), code.shape)
                np.add.at(total, (place, code), x)
                np.add.at(count, (place, code), 1)
        p, e = np.nonzero(count)
        made = [np.repeat(p, size), np.repeat(e, size), np.tile(np.arange(size), len(p)), total[p, e].reshape(-1), np.repeat(count[p, e], size)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in made], names=["part", "entry", "at", "total", "n"])

    sums = rows.select("v", "code").mapInArrow(run, "part long, entry long, at long, total long, n long")
    out = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part, r.entry, r["at"]] = r.total // r.n
    return out


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """id, label, code (array of entry numbers), error (squared distance, long) of each usable row; and the codebooks: parts x entries x components."""
    clean = rows.where(usable(vector)).select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    books = _start(clean, parts, entries)
    if not books.shape[1]:
        return clean.select("id", "label", F.array().cast("array<long>").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), books
    now, moved = clean, None
    for _ in range(rounds):
        now = materialise(_assigned(now, books, moved), "assigned")
        new = _moved(now, books)
        moved, books = (new != books).any(2), new
    last = _assigned(now, books, moved)
    return last.select("id", "label", "code", F.aggregate("far", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), books


def decompress(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """id and v, the whole numbers that a code stands for."""
    kind = coded.schema["id"].dataType
    parts = books.shape[0]

    def run(batches):
        for batch in batches:
            code = batch.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            v = books[np.arange(parts), code].reshape(len(code), -1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(v), pa.list_(pa.int64()))], names=["id", "v"])

    return coded.select("id", "code").mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.LongType()))]))


def digest(books: np.ndarray) -> str:
    """sha256 of all components, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def codes(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **how) -> DataFrame:
    """vec_id, code (two hex digits an entry), error, label_error (null if no long holds it), codebooks_sha256."""
    coded, books = compress(rows, vec_id, vector, label, **how)
    hexed = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0"))))
    coded = coded.select("id", "label", hexed.alias("code"), "error")
    if books.shape[1]:
        coded = materialise(coded, "coded")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    sums = small(sums, sums.count(), MOST_BROADCAST)
    made = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")))
    return made.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
