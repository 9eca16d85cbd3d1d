"""Byte-pair encoding and decoding with a pair occurrence index.

All words of a partition's chunk that were not met before are laid out as one symbol sequence. An index maps every
adjacent pair to its positions; a heap gives the active ranks in ascending order; merging a pair updates the lists of
the pairs beside it. Vocabulary and merges come from a public tokenizer file; nothing is trained.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import others, text_map

#: Splits a normalised text as the file's pre-tokenizer does; the first form is for ASCII, lower-cased by str.lower().
_ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
_wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
MOST_WORDS = 400_000
_ready: dict[str, "Bpe"] = {}


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where Latin-1 prints it, else the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A tokenizer file's vocabulary, merges, normaliser and special tokens."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        parts = json.loads(file)
        model = parts["model"]
        self.normalise = Tokenizer.from_str(file).normalizer.normalize_str
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.letters = byte_letters()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lead = os.path.commonprefix(list(self.special))  # a text without it holds no special token
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers: a word costs little memory
        self.names = [str(i) for i in range(max(self.token) + 1)]
        self.tokens = [self.token.get(i, "") for i in range(len(self.names))]
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.known.update({t: struct.pack("<I", i) for t, i in self.special.items()})

    def split(self, text: str) -> list[str]:
        return _ascii.findall(text.lower()) if text.isascii() else _wide.findall(self.normalise(text))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of the words, merged together over one pair index."""
        sym: list[int] = []
        first: list[int] = []
        for w in words:
            first.append(len(sym))
            letters = [self.letters[b] for b in w.encode()]
            letters[-1] += self.suffix
            sym += [self.vocab[x] for x in letters]
            sym.append(-1)  # between words; no pair holds it
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        sym.append(-1)
        rank = self.rank
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            if (pair := (sym[i], sym[i + 1])) in rank:
                index.setdefault(pair, []).append(i)
        active = [(rank[p][0], p) for p in index]
        heapq.heapify(active)
        while active:
            r, pair = heapq.heappop(active)
            todo = sorted(index.pop(pair, ()))
            a, b = pair
            new = rank[pair][1]
            for at, i in enumerate(todo):
                j = right[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                after, before = right[j], left[i]
                right[i] = after
                if after < n:
                    left[after] = i
                sooner = False
                for p, x in (((sym[before], new), before), ((new, sym[after]), i)):
                    if x >= 0 and p in rank:
                        if p not in index:
                            index[p] = []
                            heapq.heappush(active, (rank[p][0], p))
                        index[p].append(x)
                        sooner |= rank[p][0] < r
                if sooner and at + 1 < len(todo):  # a pair of lower rank has come up: it goes first
                    if pair not in index:
                        index[pair] = []
                    index[pair] += todo[at + 1 :]
                    heapq.heappush(active, (r, pair))
                    break
        out, ends = [], [*first[1:], n]
        for a, b in zip(first, ends):
            out.append([s for s in sym[a : b - 1] if s >= 0])
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MOST_WORDS:
            self.forget()
            new = list(words - self.known.keys())
        for w, ids in zip(new, self.merge(new)):
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        parts = [self.cut.split(t) if self.cut and self.lead in t else [t] for t in texts]
        words = [[w for p in ps for w in ([p] if p in self.special else self.split(p))] for ps in parts]
        self.learn(set().union(*words))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in ws]), "<i4") for ws in words]


def load(file: str) -> Bpe:
    key = hashlib.md5(file.encode()).hexdigest()
    if key not in _ready:
        _ready[key] = Bpe(file)
    return _ready[key]


def encode(docs: DataFrame, keep: list[str], path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 of every whole text, however long, and the ids themselves if asked for.

    Decoding joins the ids' tokens by blanks, as the file names no decoder. A null text counts as empty: no tokens.
    The file (a fixed vocabulary of a few MB) is broadcast. Rows are encoded one by one, so repeated ones need no rule.
    An empty table gives an empty result. Columns of docs that bear the new columns' names give way to them.
    """
    keep = others(keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if ids else []))
    spark: SparkSession = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def make(rows, texts):
        tool = load(file.value)
        name, token = tool.names.__getitem__, tool.tokens.__getitem__
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        found = tool.encode([t or "" for t in texts])
        n, first, second = [], [], []
        for d in found:
            listed = d.tolist()
            n.append(len(listed))
            first.append(sha(" ".join(map(name, listed))))
            second.append(sha(" ".join(map(token, listed))))
        return [*[rows[c] for c in keep], n, first, second, *([found] if ids else [])]

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return text_map(docs, keep, text, schema, make, 1_000_000)


def decode(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Adds column decoded to rows of ids: their tokens joined by blanks; null where the ids are null."""
    spark = rows.sparkSession
    with open(path, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches):
        token = load(file.value).token
        for batch in batches:
            texts = [None if x is None else " ".join([token[i] for i in x]) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
