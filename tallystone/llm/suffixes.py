"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Only the first `depth` bytes of a suffix count, so two suffixes are equal exactly if the windows of that length repeat.
The most-significant-digit passes go from few bytes to all:

1. The first digit of a window is its least 24-byte gram (by hash, the last of equals), found at whatever place it has
   in the window. Successive windows with the same gram form a run; runs are dealt out by the gram. A run whose gram no
   other run has is unique. Runs of equal bytes are settled at once: all but the first repeat.
2. The windows of the other runs are dealt out by their place in the run, in three ranges, and by the bytes that all
   windows of that range share (74 of 100).
3. Within such a group, eight-byte digits from the window's first byte on split it further; after each pass groups of one
   are dropped. What is left after the last digit is equal windows.

Runs are compared by 128 bits of hash in step 1; steps 2 and 3 compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, with_row_key

DEPTH, GRAM = 100, 24
WIDTH = DEPTH - GRAM + 1  # grams in a window
RANGES = ((0, 25), (26, 51), (52, WIDTH - 1))  # of the gram's place in the window
PART = 1 << 18  # bytes that are taken at once; places within them have 20 bits
PLACES = np.uint64((1 << 20) - 1)
MOST_BROADCAST = 1_000_000
_byte = np.random.Generator(np.random.PCG64(0)).integers(0, 2**64, 256, dtype=np.uint64)
_odd = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _odd + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 1, 2, 4 .. 64 bytes."""
    out, size = {1: _byte[data]}, 1
    while size < 64:
        h = out[size]
        out[2 * size] = _pair(h[:-size], h[size:])
        size *= 2
    return out


def runs(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Runs of the windows that lie within one part. parts: (row, place in the row, bytes).

    gram, hash of the run's bytes, row, place of the first window, number of windows, place of the gram after it.
    """
    size = np.array([len(p[2]) for p in parts], np.int64)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if not len(size) or size.max() < DEPTH:
        return none
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    h = _hashes(data)
    gram = _pair(h[16][: len(data) - GRAM + 1], h[8][16:])
    low = (gram & ~PLACES) | (PLACES - np.arange(len(gram), dtype=np.uint64))
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(data) - DEPTH + 1], low[WIDTH - 64 :])
    place = (PLACES - (low & PLACES)).astype(np.int64)
    begin = np.cumsum(size) - size
    good = np.zeros(len(place) + 1, np.int64)
    full = size >= DEPTH
    np.add.at(good, begin[full], 1)
    np.add.at(good, np.minimum(begin + size - DEPTH + 1, len(place))[full], -1)
    s = np.flatnonzero(np.cumsum(good[:-1]) > 0)
    p = place[s]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    a, b, p = s[first], s[last], p[first]
    whole = lambda i: _pair(_pair(h[64][i], h[32][i + 64]), h[4][i + 96])
    code = _pair(_pair(whole(a), whole(b)), ((b - a) * 256 + (p - a)).astype(np.uint64))
    of = np.searchsorted(begin, a, "right") - 1
    row, base = (np.array([x[i] for x in parts], np.int64) for i in (0, 1))
    return gram[p], code, row[of], a - begin[of] + base[of], b - a + 1, p - a


def cut(row: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Parts of a text that hold each window once."""
    for at in range(0, max(1, len(data) - DEPTH + 1), PART):
        yield row, at, data[at : at + PART + DEPTH - 1]


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each row, joined where they touch."""
    order = np.lexsort((end, begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    turn = np.concatenate([[True], row[1:] != row[:-1]])
    reach = np.maximum.accumulate(end + np.cumsum(turn) * (1 << 40)) - np.cumsum(turn) * (1 << 40)
    new = np.flatnonzero(np.concatenate([[True], turn[1:] | (begin[1:] > reach[:-1])]))
    return row[new], begin[new], np.maximum.reduceat(end, new)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """deal, code, _row, at, more. Of equal runs in a part all but the first are settled here: code is null, more their end.

    So a run that very many rows share is sent once for each part, not once for each row.
    """
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush():
        gram, code, row, at, n, p = runs(held)
        order = np.lexsort((at, row, code, gram))
        again = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = order[1:], order[:-1]
            again[a] = (code[a] == code[b]) & (gram[a] == gram[b])
        spans = merged(row[again], at[again], (at + n + DEPTH - 1)[again])
        live = ~again
        yield pa.RecordBatch.from_pydict({
            "deal": np.concatenate([gram[live].view(np.int64), spans[0] * 1_000_003]),
            "code": pa.array(np.concatenate([code[live].view(np.int64), np.zeros(len(spans[0]), np.int64)]), mask=np.concatenate([np.zeros(live.sum(), bool), np.ones(len(spans[0]), bool)])),
            "_row": np.concatenate([row[live], spans[0]]),
            "at": np.concatenate([at[live], spans[1]]),
            "more": np.concatenate([(n * 256 + p)[live], spans[2]]),
        })

    for batch in batches:
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in cut(row, data.as_py() or b""):
                if total and total + len(part[2]) > PART:
                    yield from flush()
                    held, total = [], 0
                held.append(part)
                total += len(part[2])
    if held:
        yield from flush()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, _row, at, data: for each unsettled run and range its windows' bytes, keyed by the bytes that they all share."""
    for batch in batches:
        for r in range(batch.num_rows):
            row, data, found = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
            out: tuple[list, list, list] = ([], [], [])
            for x in found:
                at, n, p = x["at"], x["more"] >> 8, x["at"] + (x["more"] & 255)
                for i, (low, high) in enumerate(RANGES):
                    a, b = max(at, p - high), min(at + n - 1, p - low)
                    if a <= b:
                        out[0].append(xxhash.xxh64_intdigest(data[p - low : p - high + DEPTH], i) - (1 << 63))
                        out[1].append(a)
                        out[2].append(data[a : b + DEPTH])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array([row] * len(out[0]), pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["key", "_row", "at", "data"])


def radix(key: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the data repeat an earlier window of the same key, as (data, window) numbers. Digits are eight bytes."""
    size = np.array([len(d) for d in data], np.int64)
    text = b"".join(data) + b"\0" * 8
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    n = size - DEPTH + 1
    owner = np.repeat(np.arange(len(data)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = (np.cumsum(size) - size)[owner] + inside
    alive = np.arange(len(place))
    group = np.unique(key, return_inverse=True)[1][owner]
    for digit in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        value = eight[place[alive] + digit]
        order = np.lexsort((value, group))
        alive, group, value = alive[order], group[order], value[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])]) if len(alive) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        alive, group = alive[many], group[many]
        if not len(alive):
            break
    if not len(alive):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((alive, group))
    alive, group = alive[order], group[order]
    later = alive[np.concatenate([[False], group[1:] == group[:-1]])]
    return owner[later], inside[later]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, begin, end of repeated windows. The input is sorted by key, _row, at; whole keys are taken, about 8 MB at once."""
    rest: pa.Table | None = None

    def done(t: pa.Table) -> pa.RecordBatch:
        key, row, at = (t.column(c).to_numpy() for c in ("key", "_row", "at"))
        owner, window = radix(key, t.column("data").to_pylist())
        begin = at[owner] + window
        return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(row[owner], begin, begin + DEPTH)], names=["_row", "begin", "end"])

    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if t.nbytes < 8 << 20:
            rest = t
            continue
        key = t.column("key").to_numpy()
        ready = int(np.searchsorted(key, key[-1]))
        if ready:
            yield done(t.slice(0, ready))
        rest = t.slice(ready)
    if rest is not None and rest.num_rows:
        yield done(rest)


def repeated_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """_row, begin, end: bytes that a window which also starts earlier covers. rows have a unique _row, whose order is the documents'."""
    texts = rows.select("_row", F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    dealt = texts.mapInArrow(_run_rows, "deal long, code long, _row long, at long, more long")
    group, ordered = Window.partitionBy("deal"), Window.partitionBy("deal").orderBy("code", "_row", "at")
    judged = dealt.select(
        "*", F.lag("code").over(ordered).alias("before"), F.min("code").over(group).alias("low"), F.max("code").over(group).alias("high")
    )
    end = F.when(F.col("code").isNull(), F.col("more")).otherwise(F.col("at") + F.shiftright("more", 8) + DEPTH - 1)
    repeats = F.col("code").isNull() | F.coalesce(F.col("before") == F.col("code"), F.lit(False))
    live = judged.where(repeats | (F.col("low") < F.col("high"))).select("_row", "at", "more", end.alias("end"), repeats.alias("repeats"))
    live = materialise(live, "runs")
    open_runs = materialise(live.where(~F.col("repeats")).groupBy("_row").agg(F.collect_list(F.struct("at", "more")).alias("_runs")), "open")
    n = open_runs.count()
    few = texts.join(F.broadcast(open_runs.select("_row")), "_row", "left_semi") if n <= MOST_BROADCAST else texts
    pieces = few.join(open_runs, "_row").select("_row", "_data", "_runs").mapInArrow(_pieces, "key long, _row long, at long, data binary")
    settled = pieces.repartition("key").sortWithinPartitions("key", "_row", "at").mapInArrow(_settle, "_row long, begin long, end long")
    return live.where("repeats").select("_row", F.col("at").alias("begin"), "end").unionByName(settled)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", output: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and kept (the bytes that are left) if output is set.

    Null texts count as empty. Rows that repeat an id come in the order of with_row_key(); equal rows repeat the first.
    Very long texts are treated whole, an empty table gives an empty result, and other columns of docs aren't read.
    """
    rows = with_row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "doc_id")
    spans = repeated_spans(rows, "_text").groupBy("_row").agg(F.collect_list(F.struct("begin", "end")).alias("_spans"))
    texts = rows.select("_row", "doc_id", F.coalesce(F.col("_text"), F.lit("")).cast("binary").alias("_data"))
    joined = texts.join(spans, "_row", "left").select("doc_id", "_data", "_spans")

    def run(batches):
        for batch in batches:
            made = [[] for _ in range(5)]
            for data, found in zip(batch.column(1), batch.column(2)):
                data, found = data.as_py(), found.as_py() or []
                begin, end = np.array([x["begin"] for x in found], np.int64), np.array([x["end"] for x in found], np.int64)
                _, begin, end = merged(np.zeros(len(begin), np.int64), begin, end)
                left, at = [], 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    left.append(data[at:b])
                    at = e
                rest = b"".join([*left, data[at:]])
                for column, x in zip(made, (len(data), len(data) - len(rest), len(begin), hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            n = 5 if output else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(made[:n], kinds)]], names=["doc_id", *names[:n]])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(run, schema + (", kept binary" if output else ""))
