"""Evaluation texts leaking into training text.

The held-out items' n-grams of normalised words are hashed into a set that is
broadcast; every training document is scanned once, its token windows are
hashed by one vectorised polynomial per batch, hits are verified word by word
against the items, and documents or only the leaked spans can be removed.

What is broadcast is checked: items are taken in blocks of about
``BLOCK_CHARS`` characters.  One block is the common case and one scan of the
corpus, without a shuffle.  More blocks are worked on one at a time: a block's
set is broadcast, scans all documents, its hits are written, and it is given
back before the next one is read.

Words are runs of letters and digits; case and accents are disregarded.
Defined cases: null, empty or shorter texts leak nothing; an item shorter than
``n`` words cannot leak; repeated items each count; very long texts are
scanned whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.durable import cut, spread

#: Words in a row that make a leak.
N_WORDS = 13
#: Characters of items whose n-grams are broadcast at once.
BLOCK_CHARS = 8_000_000

_ASCII = re.compile(r"[a-z0-9]+")
_ANY = re.compile(r"[^\W_]+")
_SPAN = re.compile(r"(?:[^\W_]|[̀-ͯ])+")
_BASE = 0x9E3779B97F4A7C15


def fold(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()) if not unicodedata.combining(ch))


def words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _ANY.findall(fold(text))


def spans(text: str) -> list[tuple[str, int, int]]:
    """Every word with its place in the text as written."""
    return [(w, m.start(), m.end()) for m in _SPAN.finditer(text) for w in words(m[0])]


class Windows:
    """Hashes of all windows of ``n`` words of a batch of documents."""

    def __init__(self, n: int):
        self.n = n
        powers = [1]
        for _ in range(n - 1):
            powers.append(powers[-1] * _BASE % 2**64)
        self.powers = np.array(powers, np.uint64)
        self.memo: dict[str, int] = {}

    def number(self, ws: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        out = []
        for w in ws:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return out

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        m = len(numbers) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for k in range(self.n):
            out += numbers[k : k + m] * self.powers[k]
        return out


def _block(items: list[tuple[int, str]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]], list[int]]:
    """Sorted window hashes with their item and place, the items' words, the items' ids."""
    win = Windows(n)
    ids, texts, hs, who, place = [], [], [], [], []
    for key, text in items:
        ws = words(text or "")
        h = win.hashes(np.array(win.number(ws), np.uint64))
        if len(h):
            hs.append(h)
            who.append(np.full(len(h), len(ids), np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
            ids.append(key)
            texts.append(ws)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), [], []
    h = np.concatenate(hs)
    order = np.argsort(h, kind="stable")
    return h[order], np.concatenate(who)[order], np.concatenate(place)[order], texts, ids


def _hits(docs: list[str | None], block, win: Windows):
    """(document number, word place, item number) of every verified window."""
    keys, who, place, texts, _ = block
    per_doc = [words(t) if t else [] for t in docs]
    lengths = np.array([len(w) for w in per_doc], np.int64)
    if not len(keys) or not lengths.sum():
        return
    flat = [x for ws in per_doc for x in win.number(ws)]
    h = win.hashes(np.array(flat, np.uint64))
    doc_of = np.repeat(np.arange(len(docs)), lengths)
    starts = np.cumsum(lengths) - lengths
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    maybe = np.flatnonzero((keys[at] == h) & (doc_of[: len(h)] == doc_of[win.n - 1 :])) if len(h) else []
    for i in maybe:
        d = int(doc_of[i])
        p = int(i - starts[d])
        k = int(at[i])
        window = per_doc[d][p : p + win.n]
        while k < len(keys) and keys[k] == h[i]:
            if texts[who[k]][place[k] : place[k] + win.n] == window:
                yield d, p, int(who[k])
            k += 1


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a list at a time of about ``block_chars`` characters, so that each can be broadcast."""
    total = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    rows = items.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    for b in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == b)).collect()]


def hits(docs: DataFrame, items: DataFrame, n: int = N_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, places array<int>: each document with every item it shares ``n`` words in a row with, and where."""
    sc = docs.sparkSession.sparkContext
    source = spread(docs.select("doc_id", "text"))
    parts: list[DataFrame] = []
    blocks = item_blocks(items.select("item_id", "text"), "item_id", "text", block_chars)
    rows, after = next(blocks), None
    while rows is not None:
        after = next(blocks, None)
        shared = sc.broadcast(_block(rows, n))

        def run(batches, shared=shared):
            block, win = shared.value, Windows(n)
            for b in batches:
                ids = b.column(0).to_pylist()
                found: dict[tuple[int, int], list[int]] = {}
                for d, p, w in _hits(b.column(1).to_pylist(), block, win):
                    found.setdefault((d, w), []).append(p)
                order = sorted(found)
                places = pa.array([sorted(set(found[k])) for k in order], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in order], pa.int64()), pa.array([block[4][w] for _, w in order], pa.int64()), places], names=["doc_id", "item_id", "places"])

        part = source.mapInArrow(run, "doc_id bigint, item_id bigint, places array<int>")
        if after is not None or parts:
            part = cut(part)
            shared.unpersist()
        parts.append(part)
        rows = after
    return reduce(DataFrame.unionByName, parts)


def leaked(docs: DataFrame, items: DataFrame, n: int = N_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id: each document with every item it shares ``n`` words in a row with."""
    # ids may repeat, in the items and among the documents
    return hits(docs, items, n, block_chars).select("doc_id", "item_id").distinct()


def without(text: str, places: Iterable[int], n: int = N_WORDS, mark: str = " ") -> tuple[str, int]:
    """The text without the spans of ``n`` words that begin at these words, and how many spans that were."""
    ws = spans(text)
    merged: list[list[int]] = []
    for p in sorted(set(places)):
        lo, hi = ws[p][1], ws[p + n - 1][2]
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    at, parts = 0, []
    for lo, hi in merged:
        parts += [text[at:lo], mark]
        at = hi
    return "".join(parts) + text[at:], len(merged)


def without_spans(docs: DataFrame, items: DataFrame, n: int = N_WORDS, block_chars: int = BLOCK_CHARS, mark: str = " ") -> DataFrame:
    """doc_id, text, n_removed: every document, its leaked spans replaced by ``mark``.

    Items of all blocks are looked for in the text as it was: spans of one block do not hide another's.  Only documents
    with hits meet them in a join; rows that repeat an id are told apart by their text.
    """
    key = F.xxhash64("doc_id", "text")
    found = hits(docs.where(F.col("text").isNotNull()).select(key.alias("doc_id"), "text"), items, n, block_chars)
    places = found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")).withColumnRenamed("doc_id", "__k")
    met = docs.select("doc_id", "text", key.alias("__k")).join(places, "__k", "left").select("doc_id", "text", "places")

    def run(batches):
        for b in batches:
            texts, counts = b.column(1).to_pylist(), [0] * b.num_rows
            for i, p in enumerate(b.column(2).to_pylist()):
                if p:
                    texts[i], counts[i] = without(texts[i], p, n, mark)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_removed"])

    return met.mapInArrow(run, "doc_id bigint, text string, n_removed int")
