"""Byte-level BPE encoding with a public vocabulary.

Two tiers. A minimal perfect hash (hash and displace, one slot per token) resolves a whole pre-token that is in
the vocabulary: one hash, one displacement, one comparison with the token in the slot. Other pre-tokens are
merged by a heap of pair ranks over a linked list of bytes, O(n log n) also for a pre-token of a megabyte; pair
ranks come from the same perfect hash. The hash is built once on the driver and broadcast (about 2 MB for 50,000
tokens, bounded by the vocabulary file); workers keep a bounded memo of recent pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that the public vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 200_000
ROWS_AT_ONCE = 500

_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


class PerfectHash:
    """Minimal perfect hash from byte strings to ranks; ``get`` returns -1 for anything else."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: float = 2.0):
        n = len(ranks)
        self.n, self.buckets = n, max(1, int(n / per_bucket))
        keys = list(ranks)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        assert len(set(hashes)) == n, "two tokens share a 64-bit hash"
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            by[h % self.buckets].append(i)
        displace = [0] * self.buckets
        owner = [-1] * n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            own = by[b]
            if len(own) > 1:
                d = 0
                while True:
                    slots = {self._slot(hashes[i], d, n) for i in own}
                    if len(slots) == len(own) and all(owner[s] < 0 for s in slots):
                        break
                    d += 1
                for i in own:
                    owner[self._slot(hashes[i], d, n)] = i
                displace[b] = d
            elif own:  # a single key takes any free slot, named directly
                free = free if free is not None else iter([s for s in range(n) if owner[s] < 0])
                s = next(free)
                owner[s] = own[0]
                displace[b] = -1 - s
        self.displace = displace
        self.keys = [keys[i] for i in owner]
        self.ranks = [ranks[keys[i]] for i in owner]

    def parts(self) -> tuple:
        """Plain data, which any worker can unpickle."""
        return self.n, self.buckets, self.displace, self.keys, self.ranks

    @classmethod
    def of(cls, parts: tuple) -> PerfectHash:
        out = cls.__new__(cls)
        out.n, out.buckets, out.displace, out.keys, out.ranks = parts
        return out

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        x = ((h ^ (d * _MIX & _MASK)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 32) % n

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d, self.n)
        return self.ranks[s] if self.keys[s] == key else -1


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, table: PerfectHash) -> list[int]:
    """BPE of one pre-token: always the pair of lowest rank, the leftmost among equals."""
    n = len(piece)
    get = table.get
    if n == 1:
        return [get(piece)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # the end of the part that begins at i; 0: merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        end[i], end[j] = stop, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(piece[i : end[k]])) >= 0:
                heapq.heappush(heap, (r, i, end[k]))
        p = before[i]
        if p >= 0 and (r := get(piece[p:stop])) >= 0:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(get(piece[i : end[i]]))
        i = after[i]
    return out


class Encoder:
    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.table, self.find, self.memo = table, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        """Token ids; the empty list for an empty and for a null text."""
        if not text:
            return []
        memo, out = self.memo, []
        for p in self.find(text):
            ids = memo.get(p)
            if ids is None:
                raw = p.encode("utf-8", "surrogatepass")
                rank = self.table.get(raw)
                ids = (rank,) if rank >= 0 else tuple(merge(raw, self.table))
                if len(ids) < 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = ids
            out.extend(ids)
        return out


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[str | None]]]:
    for d in batches:
        for s in range(0, len(d), ROWS_AT_ONCE):
            part = d.iloc[s : s + ROWS_AT_ONCE]
            yield part["doc_id"], [t if isinstance(t, str) else None for t in part["text"]]


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer files than that (a file is the least a scan splits for certain); else
    untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` for every document; no special tokens, their strings are ordinary text."""
    table = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)).parts())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(PerfectHash.of(table.value))
        for ids, texts in _texts(batches):
            yield pd.DataFrame({"doc_id": ids, "ids": [np.asarray(e.encode(t), "int32") for t in texts]})

    # ids travel as text: nulls among integers would turn them into floating point
    out = spread(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInPandas(run, "doc_id string, ids array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of token ids of the text."""
    table = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(vocabulary)).parts())
    schema = docs.select(keep).schema.add("tokens", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(PerfectHash.of(table.value))
        for d in batches:
            n = [len(e.encode(t)) if isinstance(t, str) else 0 for t in d["_text"]]
            yield d[keep].assign(tokens=np.asarray(n, "int64"))

    return spread(docs.select(*keep, F.col(text).cast("string").alias("_text"))).mapInPandas(run, schema)
