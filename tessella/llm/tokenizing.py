"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Two tiers.  A minimal perfect hash (hash and displace; one slot per vocabulary
entry, the entry kept beside it to verify) resolves whole pre-tokens that are
in the vocabulary.  The others are merged from their bytes: a heap holds the
ranks of the neighbouring pairs, a doubly linked list the parts, so a
pre-token of n bytes takes O(n log n) however long it is.  Each task keeps the
pre-tokens it has met in a table of bounded size, which only saves time.

The vocabulary is read on the driver from the path given and broadcast; its
size is fixed by the tokenizer (checked against ``MAX_VOCABULARY``).

Defined cases: null and empty texts give the empty list; text that looks like a
special token is ordinary text; every row comes out, repeated rows repeatedly.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tessella.plans.durable import spread

#: The published pre-token pattern of this tokenizer family (fixed value), white space as the Unicode property.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries that may be broadcast; a larger vocabulary is refused.
MAX_VOCABULARY = 2_000_000
#: Pre-tokens a task remembers.
MEMO = 400_000


class PerfectHash:
    """Bytes -> identifier for a fixed set of keys, without collisions and without empty slots."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("keys repeat")
        self.n_buckets = max(1, n // 3)
        self.shift = np.zeros(self.n_buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        buckets: dict[int, list[tuple[int, int, int]]] = {}
        for i, k in enumerate(keys):
            b, h, step = self._parts(k)
            buckets.setdefault(b, []).append((h, step, i))
        free = np.ones(n, bool)
        tries = np.arange(max(n, 1), dtype=np.int64)
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            self._place(b, members, free, tries, keys, values)
        self.shift = self.shift.tolist()

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        d = xxhash.xxh3_128_intdigest(key)
        # the step is odd and below n, so that walking it reaches many slots
        return (d & 0xFFFFFFFF) % self.n_buckets, ((d >> 32) & 0xFFFFFFFF) % self.n, ((d >> 64) & 0xFFFFFFFF) % max(1, self.n - 1) + 1

    def _place(self, b, members, free, tries, keys, values) -> None:
        n = self.n
        h = np.array([m[0] for m in members], np.int64)[:, None]
        step = np.array([m[1] for m in members], np.int64)[:, None]
        at = 0
        while True:
            # the displacement is a pair (times, plus): times = t // n walks the steps, plus = t % n moves all by as much
            block = np.arange(at, at + 256, dtype=np.int64)
            slots = (h + step * (block // n + 1) + block % n) % n
            ok = free[slots].all(0)
            if len(members) > 1:
                s = np.sort(slots, axis=0)
                ok &= (s[1:] != s[:-1]).all(0)
            hit = np.flatnonzero(ok)
            if len(hit):
                t = int(block[hit[0]])
                self.shift[b] = t
                for (_, _, i), slot in zip(members, slots[:, hit[0]]):
                    free[slot] = False
                    self.keys[slot] = keys[i]
                    self.values[slot] = values[i]
                return
            at += 256

    def get(self, key: bytes) -> int:
        """The identifier, or -1."""
        if not self.n:
            return -1
        b, h, step = self._parts(key)
        t = self.shift[b]
        slot = (h + step * (t // self.n + 1) + t % self.n) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} entries are too many to broadcast")
    return ranks


@lru_cache(maxsize=4)
def _perfect(path: str, mtime: float) -> PerfectHash:
    ranks = read_vocabulary(path)
    return PerfectHash(list(ranks), list(ranks.values()))


def perfect_hash(path: str) -> PerfectHash:
    return _perfect(path, os.path.getmtime(path))


def merge(piece: bytes, ranks: PerfectHash) -> list[int]:
    """BPE of one pre-token from its bytes: lowest rank first, leftmost of equal ones."""
    n = len(piece)
    ends = list(range(1, n + 1))  # part at i covers piece[i:ends[i]]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = ends[i]
        if j < n:
            r = ranks.get(piece[i : ends[j]])
            if r >= 0:
                heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = ends[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue  # a part has changed since
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        r = ranks.get(piece[i : ends[i]])
        if r < 0:
            raise ValueError("a single byte is missing from the vocabulary")
        out.append(r)
        i = ends[i]
    return out


class Encoder:
    def __init__(self, ranks: PerfectHash):
        self.ranks, self.split, self.memo = ranks, regex.compile(PATTERN), {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.split.findall(text):
            ids = memo.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                whole = self.ranks.get(raw)
                ids = (whole,) if whole >= 0 else tuple(merge(raw, self.ranks))
                if len(memo) >= MEMO:
                    memo.clear()
                if len(piece) <= 64:
                    memo[piece] = ids
            out.extend(ids)
        return out


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids of every row.  One pass, no shuffle."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(perfect_hash(vocabulary))
    kind = df.schema[id_col].dataType.simpleString()
    arrow_id = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()

    def run(batches):
        encoder = Encoder(shared.value)
        for b in batches:
            offsets, flat = [0], []
            for text in b.column(1).to_pylist():
                flat.extend(encoder.encode(text))
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(arrow_id), lists], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, ids array<int>")
