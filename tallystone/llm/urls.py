"""URL filters by a sorted digest array.

Rules are kept as a sorted array of 64-bit xxhash keys beside their full strings, in one file that each executor
memory-maps. A URL's candidate keys (its host and parent domains, with the path prefixes whose lengths occur in the
rules) are probed by vectorised binary search, and a hit counts only if the stored string is the same.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import others

#: Rules of the registered query, by the contract: host and path, then the verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_open: dict[str, "Digests"] = {}


def pack(rules: list[tuple[str, str]]) -> bytes:
    """The file: number of rules, sorted keys, path lengths, verdicts, ends of the strings, then the strings.

    Equal keys lie side by side, so a collision costs a comparison and no rule. Of repeated rules the last holds.
    """
    rows = sorted((xxhash.xxh64_intdigest(r), r.encode(), v == "block") for r, v in dict(rules).items())
    text = [r for _, r, _ in rows]
    return b"".join([
        np.array([len(rows)], "<u8").tobytes(),
        np.array([k for k, _, _ in rows], "<u8").tobytes(),
        np.array([len(r.decode()) - r.decode().index("/") for r in text], "<u8").tobytes(),
        np.array([b for _, _, b in rows], "<u8").tobytes(),
        np.cumsum([0, *map(len, text)]).astype("<u8").tobytes(),
        b"".join(text),
    ])


class Digests:
    """A packed rule file, memory-mapped."""

    def __init__(self, path: str):
        self.map = np.memmap(path, np.uint8, "r")
        n = int(self.map[:8].view("<u8")[0])
        part = lambda i, size: self.map[8 + 8 * n * i : 8 + 8 * n * i + 8 * size].view("<u8")
        self.keys, self.path_size, self.block, self.ends = part(0, n), part(1, n), part(2, n), part(3, n + 1)
        self.strings = self.map[8 + 8 * (4 * n + 1) :]
        self.path_sizes = sorted({int(x) for x in self.path_size})

    def rule(self, i: int) -> str:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes().decode()

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, bool]]:
        """Per URL the longest fitting rule, or None, and whether it blocks. Of equally long rules the one with the longer host wins."""
        texts: list[str] = []
        owner: list[int] = []
        for u, (host, path) in enumerate(zip(hosts, paths)):
            heads = [path[:n] for n in self.path_sizes if len(path) >= n]
            while host and heads:
                texts += [host + h for h in heads]
                owner += [u] * len(heads)
                host = host.partition(".")[2]
        best: list[tuple[int, int, str, bool] | None] = [None] * len(hosts)
        if texts and len(self.keys):
            keys = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
            low = np.searchsorted(self.keys, keys)
            for q in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys):
                i = int(low[q])
                while i < len(self.keys) and self.keys[i] == keys[q]:
                    if (r := self.rule(i)) == texts[q]:
                        found = (len(r), r.index("/"), r, bool(self.block[i]))
                        best[owner[q]] = max(best[owner[q]] or found, found)
                    i += 1
        return [(b[2], b[3]) if b else (None, False) for b in best]


def opened(data: bytes, name: str) -> Digests:
    """Writes the file once into the executor's own temp folder, for its workers to share, and maps it."""
    if name not in _open:
        path = os.path.join(tempfile.gettempdir(), f"urls-{name}.bin")
        if not os.path.exists(path):
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False) as f:
                f.write(data)
            os.replace(f.name, path)
        _open[name] = Digests(path)
    return _open[name]


def filter_urls(urls: DataFrame, keep: list[str], rules: list[tuple[str, str]], url: str = "url", default: str = "allow", most_mb: int = 256) -> DataFrame:
    """keep columns, host, path, rule, verdict per row.

    The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path follows up
    to `?`, `#` or the end; both are empty for null or without `://`. Without a fitting rule the verdict is default
    and the rule null. Rows are judged one by one, so repeated ones and very long urls need no rule; of equally long
    rules the one with the longer host wins. Columns of urls named as the new ones give way to them. The packed rules are broadcast; lists over most_mb are refused, to be split by host beforehand.
    """
    data = pack(rules)
    if len(data) > most_mb << 20:
        raise ValueError(f"the rules take {len(data) >> 20} MB; filter_urls() broadcasts {most_mb} MB at most")
    name, shared = hashlib.sha256(data).hexdigest()[:32], urls.sparkSession.sparkContext.broadcast(data)
    rest = F.when(F.contains(F.col(url), F.lit("://")), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    keep = others(keep, "host", "path", "rule", "verdict")
    parts = urls.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = opened(shared.value, name)
        for batch in batches:
            found = table.judge(*(batch.column(i).to_pylist() for i in (-2, -1)))
            verdicts = [default if r is None else "block" if b else "allow" for r, b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kinds = dict(parts.dtypes)
    return parts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in parts.columns) + ", rule string, verdict string")
