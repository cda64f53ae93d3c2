"""Most similar vectors for every vector: multi-index hashing.

Per collection a rotation is learned on a bounded sample (the rotation that
brings the sample nearest to the corners of a cube); the signs of the rotated
vector are its code.  Codes are split into substrings and the substrings are
indexed, on two levels:

* Routing, between tasks: the rows that agree in substring t of ``width`` bits
  meet in bucket t.  The widths follow the size of the collection so that a
  bucket stays at about ``BUCKET`` rows.  How many tables it takes is measured:
  for a few rows of every collection the true neighbours are found by one scan
  over all rows, and the tables are as many as bring ``TARGET`` of these pairs
  together.  If the first code has too few bits for that, a second one gives
  more; if both have, substrings get shorter; if nothing reaches the target,
  an error says so.
* Probing, within a bucket: all substrings of the code are indexed again, and
  by the pigeonhole principle every code within a Hamming radius r is found by
  probing each of m substrings within floor(r / m) - the first r mod m + 1 of
  them - or one less.  Codes found are compared whole; those within the radius
  are reranked by their vectors, in double precision.  A row with fewer than k
  codes within the radius is compared with the whole bucket.

Every row is indexed and every row is a query.  A row goes through one shuffle
per table, with its vector as it is.

Skew: of equal vectors only the first k + 1 (by id) can be anyone's neighbours.
A vector that holds a large share of all rows leaves the index before the
shuffle (``skew.hot_keys``); fewer copies are folded within their bucket.  A
bucket that the sample shows to be larger than ``BLOCK`` rows is worked on in
pairs of salted blocks, so that no task holds more than two blocks and no pair
of the bucket is lost.

Defined cases: a null, wrongly long, all-zero or non-finite vector takes no
part; nor do rows without an id or chunks without a model; a collection of one
gives nothing; of equal similarities the smaller id is nearer; rows that repeat
an id are one row with several vectors, and no id pairs with itself; fewer than
k others give fewer.  Ids travel as 64-bit hashes.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.plans.skew import hot_keys

K = 5
#: Vectors the rotations of all collections together are learned on, at most twice this many.
SAMPLE = 16_384
#: Rows of each collection whose true neighbours are looked up to choose radius and tables.
PROBES = 64
#: Rows of a bucket that the length of a routing substring aims at.
BUCKET = 32_768
#: A routing substring has this many bits at least, so that small collections are indexed like large ones.
LEAST_WIDTH = 2
#: Share of the true near pairs that routing must bring together, and share that must lie within the Hamming radius.
TARGET, WITHIN = 0.95, 0.99
MAX_TABLES = 16
#: Rows of a block; a bucket of more is worked on in pairs of blocks.
BLOCK = 131_072
#: Equal vectors beyond this number leave the index before the shuffle, smaller groups are folded within their bucket.
COPIES_FLOOR = 500_000
#: Rounds of the learned rotation.
ROUNDS = 30


def usable(vec: str, width: Column) -> Column:
    """The vector has the right length, only finite numbers, and not only zeros."""
    c = F.col(vec)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) == width) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def collection(df: DataFrame, name: str, id_text: Column, vec: str, width: int) -> DataFrame:
    """coll_name, part, id, vec of the usable rows of one table; ``part`` is what may be compared."""
    rows = df.where(usable(vec, F.lit(width)) & id_text.isNotNull())
    return rows.select(F.lit(name).alias("coll_name"), F.lit(name).alias("part"), id_text.alias("id"), F.col(vec).alias("vec"))


def chunk_collection(df: DataFrame) -> DataFrame:
    """Chunks compare within one embedding model; the number that ends the model's name is the length of its vectors."""
    width = F.regexp_extract("embed_model", r"(\d+)$", 1).try_cast("int")
    key = F.concat_ws(".", F.concat(F.lit("kb:"), "document_id"), F.col("version").cast("string"), F.col("ordinal").cast("string"))
    rows = df.where(F.col("embed_model").isNotNull() & usable("embedding", width))
    return rows.select(F.lit("kb_chunks").alias("coll_name"), F.concat(F.lit("kb_chunks "), "embed_model").alias("part"), key.alias("id"), F.col("embedding").alias("vec"))


# ---- codes


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Codes:
    """The learned code of one part: two rotations, and how its substrings are used.

    ``near_pairs`` are signs (both codes side by side) of true neighbours; radius, width and tables are chosen on them.
    """

    def __init__(self, sample: np.ndarray, n_rows: int | None = None, seed: int = 7):
        x = unit(sample).astype(np.float32)
        self.mean = x.mean(0)
        x = x - self.mean
        self.dim = x.shape[1]
        self.bits = min(64, self.dim)
        rng = np.random.default_rng(seed)
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits].astype(np.float32)
        turned = x @ axes
        self.n_rows = len(sample) if n_rows is None else n_rows
        self.width, self.tables, self.radius = self.ideal(BUCKET), 1, self.bits // 5
        self.rotation = np.hstack([axes @ self._rotation(turned, rng) for _ in range(2)])
        self.salts: dict[tuple[int, int], int] = {}
        self.reach, self.uuids, self.coll = 1.0, False, ""

    def ideal(self, bucket: int) -> int:
        """Bits that bring a bucket to about ``bucket`` rows."""
        return max(LEAST_WIDTH, round(np.log2(max(1.0, self.n_rows / bucket))))

    @staticmethod
    def _rotation(z: np.ndarray, rng) -> np.ndarray:
        r = np.linalg.qr(rng.normal(size=(z.shape[1],) * 2))[0].astype(np.float32)
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(z @ r).T @ z)
            r = (vt.T @ u.T).astype(np.float32)
        return r

    def signs(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.rotation) > 0

    def choose(self, left: np.ndarray, right: np.ndarray, seen: np.ndarray, block: int) -> "Codes":
        """Radius, width and tables from the signs of near pairs; salts of large buckets from the sample's signs ``seen``."""
        if len(left):
            far = (left[:, : self.bits] != right[:, : self.bits]).sum(1)
            self.radius = max(self.bits // 8, int(np.quantile(far, WITHIN, method="higher")))
            same = left == right
            for self.width in range(self.width, 0, -1):
                met = np.zeros(len(left), bool)
                for t in range(min(MAX_TABLES, 2 * self.bits // self.width)):
                    met |= same[:, t * self.width : (t + 1) * self.width].all(1)
                    self.tables, self.reach = t + 1, float(met.mean())
                    if self.reach >= TARGET:
                        break
                if self.reach >= TARGET:
                    break
            else:
                raise ValueError(f"{self.tables} tables of {self.width} bits bring only {self.reach:.2f} of the near pairs together")
        if len(seen):
            for t, column in enumerate(self.substrings(seen).T):
                values, counts = np.unique(column, return_counts=True)
                for v, c in zip(values, counts):
                    # counted generously: a bucket of few sample rows is not large
                    rows = (c + 2 * np.sqrt(c)) * self.n_rows / len(seen)
                    if rows > block:
                        self.salts[t, int(v)] = int(-(-rows // block))
        return self

    def substrings(self, signs: np.ndarray) -> np.ndarray:
        """A bucket number per row and table."""
        powers = 1 << np.arange(self.width, dtype=np.int64)
        return np.stack([signs[:, t * self.width : (t + 1) * self.width] @ powers for t in range(self.tables)], axis=1)

    def packed(self, signs: np.ndarray) -> np.ndarray:
        """The first code as one integer."""
        full = np.zeros((len(signs), 64), np.uint8)
        full[:, : self.bits] = signs[:, : self.bits]
        return np.packbits(full, axis=1, bitorder="little").view(np.uint64).ravel()


def _matrix(col: pa.ListArray, at: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    width = ends[at[0] + 1] - ends[at[0]]
    return flat[ends[at][:, None] + np.arange(width)]


def _by_part(batch: pa.RecordBatch, number: dict[str, int]):
    """(part number, rows, their vectors as they are) of every part in a batch with ``part`` first and ``vec`` last."""
    part = np.array([number[p] for p in batch.column(0).to_pylist()], np.int64)
    col = batch.column(batch.num_columns - 1)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(np.array(col.value_lengths()))]
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield int(p), at, _matrix(col, at, flat, ends)


def learn(rows: DataFrame, k: int = K, sample: int = SAMPLE) -> tuple[list[str], list[Codes]]:
    """Parts and their codes.

    The rotations come from at most ``2 * sample`` rows of all parts together, chosen by a hash of the id; radius and
    tables from the true neighbours of ``PROBES`` rows a part, found by one scan over all rows.
    """
    facts = {r["part"]: r for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("id").rlike(_UUID)).alias("uuids"), F.min("coll_name").alias("coll")).collect()}
    counts = {p: r["n"] for p, r in facts.items()}
    names = sorted(counts)
    if not names:
        return [], []
    number = {p: i for i, p in enumerate(names)}
    each = max(256, sample // len(names))
    share = F.create_map(*[F.lit(v) for p in names for v in (p, max(1, counts[p] // each))])
    picked = rows.where(F.pmod(F.xxhash64("id"), share[F.col("part")]) == 0).select("part", F.xxhash64("id").alias("h"), "vec").toArrow()
    parts, order = np.asarray(picked.column("part").to_pylist()), np.argsort(picked.column("h").to_numpy(), kind="stable")
    vecs = picked.column("vec").to_pylist() if picked.num_rows else []
    samples: list[np.ndarray] = []
    for p in names:
        own = [vecs[i] for i in order if parts[i] == p] if len(vecs) else []
        # a part whose every id missed the hash is small enough to need no rotation
        width = len(own[0]) if own else rows.where(F.col("part") == p).select(F.size("vec")).first()[0]
        samples.append(np.array(own, np.float64) if own else np.eye(width))
    learned = [Codes(x, counts[p]) for p, x in zip(names, samples)]
    for p, c in zip(names, learned):
        c.uuids, c.coll = facts[p]["uuids"], facts[p]["coll"]
    shared = rows.sparkSession.sparkContext.broadcast((learned, [unit(x[:PROBES]) for x in samples]))

    def scan(batches):
        codes, probes = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for p, at, x in _by_part(b, number):
                y = unit(x)
                s = probes[p] @ y.T
                s[s > 1 - 1e-12] = -2  # itself and its copies
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                sims = np.take_along_axis(s, top, 1)
                bits = np.packbits(codes[p].signs(y[top.ravel()].astype(np.float32)), axis=1).reshape(*top.shape, -1)
                if p in best:
                    sims, bits = np.hstack([best[p][0], sims]), np.concatenate([best[p][1], bits], axis=1)
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    sims, bits = np.take_along_axis(sims, top, 1), np.take_along_axis(bits, top[:, :, None], 1)
                best[p] = (sims, bits)
        for p, (sims, bits) in best.items():
            q, j = np.nonzero(sims > -2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), p), pa.int64()), pa.array(q, pa.int64()), pa.array(sims[q, j]), pa.array([bits[a, c].tobytes() for a, c in zip(q, j)], pa.binary())], names=["p", "q", "s", "bits"]
            )

    near = rows.select("part", "vec").mapInArrow(scan, "p bigint, q bigint, s double, bits binary")
    rank = F.row_number().over(Window.partitionBy("p", "q").orderBy(F.desc("s"), "bits"))
    true = near.withColumn("n", rank).where(F.col("n") <= k).select("p", "q", "bits").toArrow()
    ps, qs, raw = true.column("p").to_numpy(), true.column("q").to_numpy(), true.column("bits").to_pylist()
    for p, (c, x) in enumerate(zip(learned, samples)):
        at = np.flatnonzero(ps == p)
        seen = c.signs(unit(x).astype(np.float32))
        two = 2 * c.bits
        right = np.unpackbits(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), -1), axis=1)[:, :two].astype(bool) if len(at) else np.zeros((0, two), bool)
        c.choose(seen[qs[at]], right, seen, BLOCK)
    return names, learned


# ---- within a bucket


def _substrings(bits: int, n: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius to probe) of the substrings of a code, for ``n`` codes: a pair within ``radius`` meets in one."""
    m = max(1, bits // int(np.clip(round(np.log2(max(2, n))), 8, 16)))
    rho, rest = divmod(radius, m)
    out, at = [], 0
    for t in range(m):
        w = bits // m + (t < bits % m)
        probe = rho if t <= rest else rho - 1
        if probe >= 0:
            out.append((at, w, min(probe, w)))
        at += w
    return out


def _patterns(width: int, most: int) -> np.ndarray:
    """The differences of at most ``most`` bits, but none at all."""
    return np.array([sum(1 << i for i in c) for d in range(1, most + 1) for c in itertools.combinations(range(width), d)], np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one after another."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


#: Probes looked up at once, and candidates compared at once.
_STEP = 1 << 18


def code_pairs(codes: np.ndarray, bits: int, radius: int, most: float = np.inf):
    """(i, j) of all pairs of codes within the Hamming radius, each once, in pieces.

    None ends the pieces where scanning all is cheaper: more probes than codes, or more than ``most`` candidates.
    """
    n, met = len(codes), 0
    parts = _substrings(bits, n, radius)
    if sum(math.comb(w, d) for _, w, probe in parts for d in range(probe + 1)) > max(n, 2_048) and n > 2:
        # more probes than codes
        yield None
        return
    done: list[tuple[np.uint64, int]] = []
    for shift, width, probe in parts:
        sub = ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        sub, own = sub[order], codes[order]
        off = np.r_[0, np.cumsum(np.bincount(sub, minlength=1 << width))]

        def compare(q: np.ndarray, c: np.ndarray):
            x = own[q] ^ own[c]
            keep = np.bitwise_count(x) <= radius
            x = x[keep]
            # a pair that an earlier substring has found is no news
            fresh = np.ones(len(x), bool)
            for mask, r in done:
                fresh &= np.bitwise_count(x & mask) > r
            return order[q[keep][fresh]], order[c[keep][fresh]]

        # equal substrings: each with those after it
        after = off[sub + 1] - np.arange(n) - 1
        bounds = np.searchsorted(np.cumsum(after), np.arange(0, after.sum() + _STEP, _STEP), side="left")
        for lo, hi in zip(bounds[:-1], [*bounds[1:-1], n]):
            at = np.arange(lo, hi)
            met += int(after[at].sum())
            if met > most:
                yield None
                return
            yield compare(np.repeat(at, after[at]), _ranges(at + 1, after[at]))
        flips = _patterns(width, probe)
        step = max(1, _STEP // n)
        for lo in range(0, len(flips), step):
            f = flips[lo : lo + step, None]
            goal = sub[None, :] ^ f
            # of the two codes of a pair the one without the highest bit that differs asks
            count = np.where(goal > sub[None, :], off[goal + 1] - off[goal], 0).ravel()
            hit = np.flatnonzero(count)
            starts, count = off[goal.ravel()[hit]], count[hit]
            cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + _STEP, _STEP), side="left")
            for a, b in zip(cuts[:-1], [*cuts[1:-1], len(hit)]):
                met += int(count[a:b].sum())
                if met > most:
                    yield None
                    return
                yield compare(np.repeat(hit[a:b] % n, count[a:b]), _ranges(starts[a:b], count[a:b]))
        done.append((np.uint64(((1 << width) - 1) << shift), probe))


def _similar(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for lo in range(0, len(a), 32_768):
        part = slice(lo, lo + 32_768)
        out[part] = np.einsum("ij,ij->i", y[a[part]], y[b[part]])
    return out


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int):
    """Of the pairs (a, b) the k most similar b of each a; of equal ones the smaller b (rows stand in the order of their ids)."""
    if not len(a):
        return a, b, s
    # one integer: row, then similarity falling; sums of one product in another order are equal
    key = (a << 44) | np.rint((1 - s) * (1 << 42)).astype(np.int64).clip(0)
    order = np.argsort(key)
    if (np.diff(key[order]) == 0).any():
        order = np.lexsort((b, key))
    a, b, s = a[order], b[order], s[order]
    start = np.flatnonzero(np.r_[True, np.diff(a) > 0])
    best = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < k
    return a[best], b[best], s[best]


def _against_all(rows: np.ndarray, y: np.ndarray, k: int):
    """The k best of ``rows`` among the whole bucket."""
    n, parts = len(y), []
    z = y.astype(np.float32)
    m = min(k, n - 1)
    step = max(1, 4_000_000 // n)
    for lo in range(0, len(rows), step):
        own = rows[lo : lo + step]
        sims = z[own] @ z.T
        sims[np.arange(len(own)), own] = -2
        # all that may reach the last place in double precision
        least = np.partition(sims, n - m, axis=1)[:, n - m] - 1e-5
        a, b = np.nonzero(sims >= least[:, None])
        a = own[a]
        keep = a != b
        a, b = a[keep], b[keep]
        parts.append(_best(a, b, _similar(a, b, y), k))
    return tuple(np.concatenate(z) for z in zip(*parts))


def nearest(y: np.ndarray, codes: Codes, k: int):
    """(row, neighbour, similarity) of the k best of each row of ``y``, unit vectors in the order of their ids."""
    n = len(y)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if n < 2:
        return none
    found, held, parts = np.zeros(n, np.int64), [], []

    def flush():
        if held:
            a, b, s = (np.concatenate(z) for z in zip(*held))
            held.clear()
            parts.append(_best(np.r_[a, b], np.r_[b, a], np.r_[s, s], k))

    size = 0
    for pair in code_pairs(codes.packed(codes.signs(y.astype(np.float32))), codes.bits, codes.radius, most=n * max(n / 6, 4_096)):
        if pair is None:
            # vectors against vectors
            return _against_all(np.arange(n), y, k)
        a, b = pair
        if len(a):
            found += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            held.append((a, b, _similar(a, b, y)))
            size += len(a)
            if size > 4_000_000:
                flush()
                size = 0
    flush()
    short = np.flatnonzero(found < k)
    if len(short):
        parts.append(_against_all(short, y, k))
    return _best(*(np.concatenate(z) for z in zip(*parts)), k)


def bucket_neighbours(ids: pa.Array, vh: np.ndarray, x: np.ndarray, codes: Codes, k: int):
    """(row, neighbour, similarity) within one bucket; rows are numbers in ``ids``."""
    order = pc.sort_indices(ids).to_numpy()
    y, vh = unit(x[order]), vh[order]
    same = np.lexsort((np.arange(len(vh)), vh))
    start = np.flatnonzero(np.r_[True, np.diff(vh[same]) != 0])
    size = np.diff(np.r_[start, len(vh)])
    place = np.arange(len(vh)) - np.repeat(start, size)
    lead = np.sort(same[place <= k])
    a, b, s = nearest(y[lead], codes, k)
    a, b = lead[a], lead[b]
    extra = np.flatnonzero(place > k)
    if len(extra):
        # further copies: the first k of their kind are their nearest
        firsts = _ranges(np.repeat(start, size)[extra], np.full(len(extra), k))
        a, b, s = np.r_[a, np.repeat(same[extra], k)], np.r_[b, same[firsts]], np.r_[s, np.ones(len(extra) * k)]
    return order[a], order[b], s


# ---- dataflow


#: An id that 16 bytes can stand for, in the same order.
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _rid() -> Column:
    return F.xxhash64("part", "id")


def _short(names: list[str], learned: list[Codes]) -> Column:
    """The id as bytes that keep its order within its part."""
    plain = F.encode("id", "UTF-8")
    of_uuids = [p for p, c in zip(names, learned) if c.uuids]
    return F.when(F.col("part").isin(of_uuids), F.unhex(F.replace("id", F.lit("-"), F.lit("")))).otherwise(plain) if of_uuids else plain


def _long(short: str, uuids: Column) -> Column:
    h = F.lower(F.hex(short))
    return F.when(uuids, F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))).otherwise(F.decode(short, "UTF-8"))


def neighbours(rows: DataFrame, k: int = K, index: tuple[list[str], list[Codes]] | None = None) -> DataFrame:
    """From coll_name, part, id, vec: rid, near array<bigint> of at most k; rid is the hash of part and id.  ``index``: from ``learn``."""
    sc = rows.sparkSession.sparkContext
    names, learned = index or learn(rows, k)
    if not names:
        return rows.select(_rid().alias("rid"), F.array(F.lit(0).cast("bigint")).alias("near"))
    shared = sc.broadcast(learned)
    number = {p: i for i, p in enumerate(names)}
    work = rows.select("part", _rid().alias("rid"), _short(names, learned).alias("id"), "vec")
    copies = None
    tagged = work.withColumn("__v", F.xxhash64("vec"))
    hot = hot_keys(tagged, ["part", "__v"], floor=COPIES_FLOOR) if sum(c.n_rows for c in learned) > COPIES_FLOOR else None
    if hot is not None:
        # all but the first k + 1 of a very common vector leave the index; their nearest are the first k
        mine = tagged.join(F.broadcast(hot), ["part", "__v"], "left_semi")
        firsts = mine.withColumn("__n", F.row_number().over(Window.partitionBy("part", "__v").orderBy("id", "rid"))).where(F.col("__n") <= k + 1)
        few = firsts.groupBy("part", "__v").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "rid"))), lambda e: e["rid"]).alias("firsts"))
        copies = mine.join(F.broadcast(few), ["part", "__v"]).where(~F.array_contains("firsts", F.col("rid"))).select("rid", F.slice("firsts", 1, k).alias("near"))
        rest = tagged.join(F.broadcast(hot), ["part", "__v"], "left_anti")
        work = rest.select(work.columns).unionByName(firsts.select(work.columns))

    def route(batches):
        models = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rid, ids = b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            for p, at, x in _by_part(b, number):
                m = models[p]
                y = unit(x)
                buckets = m.substrings(m.signs(y.astype(np.float32)))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * m.dim), len(at), [None, pa.py_buffer(np.ascontiguousarray(x, "<f4"))]).cast(pa.binary())
                own_ids = ids.take(pa.array(at))
                own = rid[at]
                for t in range(m.tables):
                    # part, table and pair of blocks share the upper half of the key
                    if not any(table == t for table, _ in m.salts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array((t << 40) | buckets[:, t]), pa.array(np.zeros(len(at), np.int64)), pa.array(own), own_ids, raw], names=_ROUTED)
                        continue
                    salts = np.array([m.salts.get((t, int(v)), 1) for v in buckets[:, t]])
                    block = (own.view(np.uint64) >> np.uint64(7)) % salts.astype(np.uint64)
                    i = np.repeat(np.arange(len(at)), salts)
                    other = _ranges(np.zeros(len(at), np.int64), salts)
                    mine = block[i].astype(np.int64)
                    pair = (np.minimum(mine, other) << 20) | np.maximum(mine, other)
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p, np.int32)), pa.array((t << 40) | buckets[i, t]), pa.array(pair), pa.array(own[i]), own_ids.take(take), raw.take(take)], names=_ROUTED)

    def search(table: pa.Table) -> pa.Table:
        codes = shared.value[table.column("p")[0].as_py()]
        rid = table.column("rid").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f4").reshape(len(rid), -1)
        ids = table.column("id").combine_chunks()
        y = unit(x)
        vh = np.ascontiguousarray(np.round(y, 12) + 0.0).view(np.dtype((np.void, 8 * y.shape[1]))).ravel()
        _, vh = np.unique(vh, return_inverse=True)
        q, c, s = bucket_neighbours(ids, vh, x, codes, k)
        keep = rid[q] != rid[c]
        q, c, s = q[keep], c[keep], s[keep]
        order = np.argsort(q, kind="stable")
        q, c, s = q[order], c[order], s[order]
        start = np.flatnonzero(np.r_[True, np.diff(q) > 0]) if len(q) else np.zeros(0, int)
        offsets = pa.array(np.r_[start, len(q)].astype(np.int32))
        return pa.table({"rid": pa.array(rid[q[start]], pa.int64()), "far": pa.ListArray.from_arrays(offsets, pa.array(np.rint((1 - s) * (1 << 30)).astype(np.int64).clip(0, 2**31 - 1).astype(np.int32))), "near": pa.ListArray.from_arrays(offsets, pa.array(rid[c], pa.int64()))})

    routed = work.mapInArrow(route, "p int, k bigint, pair bigint, rid bigint, id binary, v binary")
    found = routed.groupBy("p", "k", "pair").applyInArrow(search, "rid bigint, far array<int>, near array<bigint>")
    # a short list per table meets here
    merged = found.select("rid", F.arrays_zip("far", "near").alias("z")).groupBy("rid").agg(F.flatten(F.collect_list("z")).alias("z"))
    top = merged.select("rid", F.transform(F.slice(F.array_sort(F.array_distinct("z")), 1, k), lambda e: e["near"]).alias("near"))
    return top if copies is None else top.unionByName(copies)


_ROUTED = ["p", "k", "pair", "rid", "id", "v"]


def similar_pairs(collections: list[DataFrame], k: int = K) -> DataFrame:
    """coll_name, id_a, id_b: pairs of which one is among the other's k nearest, the smaller id first."""
    rows = reduce(DataFrame.unionByName, collections)
    names, learned = index = learn(rows, k)
    pairs = neighbours(rows, k, index).select("rid", F.explode("near").alias("other"))
    pairs = pairs.select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b")).where("a <> b").distinct()
    if not names:
        return pairs.select(F.lit("").alias("coll_name"), F.lit("").alias("id_a"), F.lit("").alias("id_b"))
    # names travel short: the part as a number, the id as bytes
    numbers = F.create_map(*[F.lit(v) for i, p in enumerate(names) for v in (p, i)])
    ids = rows.select(_rid().alias("rid"), numbers[F.col("part")].alias("p"), _short(names, learned).alias("id"))
    ids = ids.groupBy("rid").agg(F.first("p").alias("p"), F.first("id").alias("id"))
    named = pairs.join(ids.select(F.col("rid").alias("a"), "p", F.col("id").alias("x")), "a").join(ids.select(F.col("rid").alias("b"), F.col("id").alias("y")), "b")
    uuids = F.col("p").isin([i for i, c in enumerate(learned) if c.uuids])
    coll = F.create_map(*[F.lit(v) for i, c in enumerate(learned) for v in (i, c.coll)])[F.col("p")]
    text = named.select(coll.alias("coll_name"), _long("x", uuids).alias("x"), _long("y", uuids).alias("y"))
    return text.select("coll_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def recall(rows: DataFrame, share: int = 100, k: int = K) -> DataFrame:
    """coll_name, n_true, n_found: the neighbours of one row in ``share`` (by a hash of the id) by brute force, and how many the index finds.

    The queries are a broadcast in blocks of a checked size; all rows are scanned for each block.
    """
    spark = rows.sparkSession
    asked = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("part", "id", "vec")
    n = max(1, -(-asked.count() // 20_000))
    out = []
    for block in range(n):
        held: dict[str, tuple[list, np.ndarray]] = {}
        for r in asked.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)) == block).collect():
            held.setdefault(r["part"], ([], []))
            held[r["part"]][0].append(r["id"])
            held[r["part"]][1].append(r["vec"])
        shared = spark.sparkContext.broadcast({p: (i, unit(np.array(v))) for p, (i, v) in held.items()})

        def scan(batches, shared=shared):
            for b in batches:
                parts, ids = np.array(b.column(0).to_pylist()), b.column(1).to_pylist()
                vecs = b.column(2).to_pylist()
                for p in set(parts) & set(shared.value):
                    qids, q = shared.value[p]
                    at = np.flatnonzero(parts == p)
                    s = np.round(q @ unit(np.array([vecs[i] for i in at])).T, 12)
                    s[np.array(qids)[:, None] == np.array([ids[i] for i in at])[None]] = -2
                    m = min(k, len(at))
                    least = np.partition(s, len(at) - m, axis=1)[:, len(at) - m]
                    x, y = np.nonzero((s >= least[:, None]) & (s > -2))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(x), pa.string()), pa.array([qids[i] for i in x], pa.string()), pa.array([ids[at[j]] for j in y], pa.string()), pa.array(s[x, y])], names=["part", "id", "other", "s"])

        out.append(rows.select("part", "id", "vec").mapInArrow(scan, "part string, id string, other string, s double"))
    rank = F.row_number().over(Window.partitionBy("part", "id").orderBy(F.desc("s"), "other"))
    true = reduce(DataFrame.unionByName, out).withColumn("n", rank).where(F.col("n") <= k)
    true = true.select("part", F.xxhash64("part", "id").alias("rid"), F.xxhash64("part", "other").alias("other"))
    near = neighbours(rows, k).select("rid", F.explode("near").alias("other"), F.lit(1).alias("hit"))
    return true.join(near, ["rid", "other"], "left").groupBy("part").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
