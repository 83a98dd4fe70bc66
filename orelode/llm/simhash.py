"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart have a variant in common that is at most half as far from either. Every
distinct fingerprint emits all variants within half the radius; variants are shuffled, and those that collide are
verified. Variants travel in a compact form: by their first bits, with the fingerprint and the number of flips still
free, one row for each reachable prefix; the receiving task spreads the remaining bits out. All fingerprints that
share a variant are within the radius of each other, so a chain through them keeps every link's component without
all pairs. The prefix is as long as the number of fingerprints asks for, so that a task's variants stay bounded; where
a cell is fuller than others, its task splits it by the next bits.

One fingerprint of 64 bits within 4 finds few texts whose shingle sets are 0.8 alike: their fingerprints differ in about
ten bits. ``similar_links`` therefore takes ``TABLES`` shorter fingerprints of each set and hashes the balls of each; what
collides in any is a candidate, whatever else collides with it. Candidates are sifted where they meet, by their sizes and
by a sketch that estimates their similarity (a bit each of ``MARKS`` least hashes), and the sets themselves decide. What a
first pass has joined counts as one class: of a fingerprint's rows only those meet that are of different classes, and the
sets of those go to their cells, which hand on fewer links than they have rows.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate, combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.components import Forest, components, grouped_back
from orelode.llm.runtime import dropped, fresh, record, task, values, written

BITS, SEED = 64, 42
#: Variants that a cell holds on average, and that a task sorts at once: 8 bytes each, and a few times that while they are sorted.
CELL, AT_ONCE = 2_000_000, 500_000
#: For similarity of sets: bits of a short fingerprint, tables of them, their radius, and variants of a table's cell. Texts
#: 0.8 alike share a ball in one table with a probability of 0.27, so in one of ten with 0.96; more alike ones with more.
SHORT, TABLES, NEAR, SHORT_CELL = 40, 10, 4, 64_000_000
#: Words of 64 bits that hold all short fingerprints, and marks of a sketch: two sets agree in a mark with probability
#: (1 + similarity) / 2. Of MARKS marks, sets that are 0.8 alike agree in 461 with a deviation of 6.8: with fewer than
#: LEAST of them (error 0.006) they aren't 0.8 alike, from CERTAIN on (error below 1e-6) they are.
WORDS, MARKS, LEAST, CERTAIN = 7, 512, 444, 494
#: Pairs that are held at once, and those of a fingerprint's rows beyond which rows meet the next ones in some orders of
#: their marks only: over 20,000 rows of as many classes that share a fingerprint of a cell.
PART, MOST, ORDERS, NEXT = 200_000, 400_000_000, 16, 64
HASHED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
CELLS = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("free", pa.int32())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str, k: int) -> bytes:
    """XXH64 (big-endian) of each shingle of k words; of the whole sequence if there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both take ASCII only
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return digest(joined, SEED)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)])


def fingerprint(text: str, k: int) -> int:
    """As a signed 64-bit integer; zero for a text without words."""
    raw = shingle_hashes(text, k)
    n = len(raw) // 8
    if not n:
        return 0
    rows, ones = np.frombuffer(raw, np.uint8).reshape(-1, 8), np.zeros(BITS, np.int64)
    for at in range(0, n, 60_000):  # so many fit 16 bits
        ones += np.add.reduce(np.unpackbits(rows[at : at + 60_000], axis=1), axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(batches, k: int):
    for batch in batches:
        yield record(HASHED, doc_id=batch.column("doc_id"), fp=[fingerprint(t or "", k) for t in values(batch, "text")])


def masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of so many bits with at most so many ones, by their count of ones."""
    return np.array([sum(1 << i for i in c) for n in range(min(flips, bits) + 1) for c in combinations(range(bits), n)], np.uint64)


def spread_cells(batches, prefix: int, half: int):
    """Each prefix that a variant can have, with the flips left for the other bits."""
    flips = masks(prefix, half)
    free = (half - np.bitwise_count(flips)).astype(np.int32)
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            some = fp[at : at + 20_000]
            top = some.view(np.uint64) >> np.uint64(BITS - prefix) if prefix else np.zeros(len(some), np.uint64)
            cell = (top[:, None] ^ flips[None, :]).ravel().astype(np.int64)
            yield record(CELLS, cell=cell, fp=np.repeat(some, len(flips)), free=np.tile(free, len(some)))


def size_of(bits: int, free: np.ndarray) -> int:
    n = np.bincount(free)
    return sum(int(n[f]) * sum(comb(bits, i) for i in range(f + 1)) for f in range(len(n)))


def sorted_variants(fp: np.ndarray, own: np.ndarray, left: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """All variants in the last ``b`` bits, in order, and whose (index) they are; equal ones are in one order everywhere."""
    low = fp[own] & np.uint64((1 << b) - 1)
    bits_of = int(len(fp)).bit_length()
    packed = b + bits_of <= BITS
    variants, source = [], []
    for f in np.unique(left):
        m, some = masks(b, int(f)), left == f
        made = (low[some][:, None] ^ m[None, :]).ravel()
        of = np.repeat(own[some].astype(np.int32), len(m))
        if packed:
            made <<= np.uint64(bits_of)
            made |= of.astype(np.uint64)
        else:
            source.append(of)
        variants.append(made)
    variants = np.concatenate(variants)
    if packed:
        variants.sort()
        source = (variants & np.uint64((1 << bits_of) - 1)).astype(np.int64)
        variants >>= np.uint64(bits_of)
        return variants, source
    order = np.argsort(variants, kind="stable")
    return variants[order], np.concatenate(source)[order]


def collisions(fp: np.ndarray, free: np.ndarray, bits: int, at_once: int = AT_ONCE):
    """Neighbours among the fingerprints that share a variant: (index, index) arrays. Splits by the next bit if many."""
    stack = [(np.arange(len(fp)), free, bits)]
    while stack:
        own, left, b = stack.pop()
        if len(own) < 2:
            continue
        if b and size_of(b, left) > at_once:
            bit = (fp[own] >> np.uint64(b - 1)) & np.uint64(1)
            for side in (0, 1):
                after = left - (bit != side)
                keep = after >= 0
                stack.append((own[keep], after[keep], b - 1))
            continue
        variants, source = sorted_variants(fp, own, left, b)
        same = np.flatnonzero(variants[1:] == variants[:-1])
        if len(same):
            pairs = np.unique(source[same].astype(np.int64) * len(fp) + source[same + 1])
            yield pairs // len(fp), pairs % len(fp)


def ball_pairs(fp: np.ndarray, free: np.ndarray, kind: np.ndarray, bits: int, at_once: int = AT_ONCE):
    """All pairs of distinct fingerprints of different kinds that share a variant, as (index, index) arrays.

    ``kind`` is -1 for a fingerprint that is of several. What only one kind shares is left before pairs are made, a ball
    bounds the fingerprints of a variant, and pairs are handed on by ``PART``; a pair may come more than once.
    """
    stack = [(np.arange(len(fp)), free, bits)]
    while stack:
        own, left, b = stack.pop()
        if len(own) < 2 or kind[own[0]] >= 0 and (kind[own] == kind[own[0]]).all():
            continue
        if b and size_of(b, left) > at_once:
            bit = (fp[own] >> np.uint64(b - 1)) & np.uint64(1)
            for side in (0, 1):
                after = left - (bit != side)
                stack.append((own[after >= 0], after[after >= 0], b - 1))
            continue
        variants, source = sorted_variants(fp, own, left, b)
        equal = variants[1:] == variants[:-1]
        shared = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        variants, source = variants[shared], source[shared]
        if not len(variants):
            continue
        kinds = kind[source]
        firsts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
        low = np.minimum.reduceat(kinds, firsts)
        mixed = np.repeat((low < 0) | (low != np.maximum.reduceat(kinds, firsts)), np.diff(np.append(firsts, len(variants))))
        variants, source, kinds = variants[mixed], source[mixed], kinds[mixed]
        del equal, shared, firsts, low, mixed
        codes, held, at, d = [], 0, np.flatnonzero(variants[1:] == variants[:-1]), 1
        while len(at):
            differ = at[(kinds[at] != kinds[at + d]) | (kinds[at] < 0)]
            x, y = source[differ].astype(np.int64), source[differ + d].astype(np.int64)
            codes.append(np.unique(np.minimum(x, y) * len(fp) + np.maximum(x, y)))
            held += len(codes[-1])
            d += 1
            at = at[at + d < len(variants)]
            at = at[variants[at] == variants[at + d]]
            if held > PART or not len(at):
                pairs = np.unique(np.concatenate(codes))
                codes, held = [], 0
                yield pairs // len(fp), pairs % len(fp)


def between(kind: np.ndarray, first: np.ndarray, second: np.ndarray | None, told: np.ndarray):
    """Pairs of rows of different classes, of one list or of two: index arrays of at most ``PART`` or one row's pairs.

    The most frequent class is taken apart, so a list that is nearly one class costs its others only. Beyond ``MOST``
    pairs rows meet the next ``NEXT`` in ``ORDERS`` orders of their marks instead.
    """
    rows = first if second is None else np.concatenate([first, second])
    classes, n = np.unique(kind[rows], return_counts=True)
    if len(classes) < 2:
        return
    common = classes[n.argmax()]
    others = rows[kind[rows] != common]
    if len(others) * len(rows) > MOST:
        rng = np.random.default_rng(SEED)
        for _ in range(ORDERS):
            words = rng.permutation(told.shape[1])
            order = rows[np.lexsort([told[rows, w] for w in words])]
            for d in range(1, min(NEXT, len(order) - 1) + 1):
                yield order[:-d], order[d:]
        return
    step = max(1, PART // len(rows))
    for at in range(0, len(others), step):
        some = others[at : at + step]
        x, y = np.repeat(some, len(rows)), np.tile(rows, len(some))
        keep = (kind[x] != kind[y]) & ((kind[y] == common) | (x < y))
        yield x[keep], y[keep]


def link_cells(batches, prefix: int, radius: int):
    """Rows come sorted by cell. Verified edges of each cell, as a forest."""
    cell, held, left = None, [], []

    def done():
        fp, free = np.concatenate(held).view(np.uint64), np.concatenate(left)
        forest = Forest()
        for a, b in collisions(fp, free, BITS - prefix):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            for x, y in zip(fp[a[near]].view(np.int64).tolist(), fp[b[near]].view(np.int64).tolist(), strict=True):
                forest.link(x, y)
        rows = list(forest.stars())
        if rows:
            yield record(EDGES, a=[a for a, _ in rows], b=[b for _, b in rows])

    for batch in batches:
        cells, fp, free = (batch.column(c).to_numpy(zero_copy_only=False) for c in CELLS.names)
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and cells[a] != cell:
                yield from done()
                held, left = [], []
            cell = cells[a]
            held.append(fp[a:b].copy())
            left.append(free[a:b].copy())
    if held:
        yield from done()


def near_links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Edges between the fingerprints (column ``fp``) that keep each component of links within the radius whole."""
    half = (radius + 1) // 2
    all_variants = max(1, n) * sum(comb(BITS, i) for i in range(half + 1))
    prefix = min(40, max(0, round(log2(all_variants / CELL)) if all_variants > CELL else 0))
    cells = distinct.select("fp").mapInArrow(task(__name__, "spread_cells", prefix=prefix, half=half), "cell long, fp long, free int")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that cells aren't put together by their bytes
    return cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(task(__name__, "link_cells", prefix=prefix, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for each row; ``component_id`` is the least ``doc_id`` that links reach.

    Fingerprints link at ``radius`` or fewer differing bits. A null text is one without words: fingerprint zero, linked
    like any other. A null key stays null and is no component's least, unless it has no other. Repeated rows stay, other
    columns go, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = written(rows.mapInArrow(task(__name__, "fingerprints", k=shingle), "doc_id long, fp long"))
    distinct = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = written(components(near_links(distinct, distinct.count(), radius)).withColumnRenamed("node", "fp").join(distinct, "fp"))
    lows = grouped_back(linked, "component", F.min("low"), "component_id", linked.count()).select("fp", "component_id")
    of = written(distinct.select("fp", "low").join(lows, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return hashed.join(of, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.frombuffer(shingle_hashes(text, k), ">u8").astype(np.uint64))


def sketch(own: np.ndarray) -> list[int]:
    """``WORDS`` numbers of 64 bits; a bit is set if it is in over half of the set's members, each mixed anew for each word."""
    ones = np.zeros(BITS * WORDS, np.int64)
    salts = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(own), 20_000):
        x = own[at : at + 20_000, None] ^ salts
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(own)).view(np.int64).tolist()


@cache
def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms, the same in every task."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, MARKS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, MARKS, np.uint32)


def marks(own: np.ndarray) -> bytes:
    """A bit of the least hash of the set under each of ``MARKS`` hash functions; ones for an empty set."""
    factors, terms = hash_functions()
    members = (own ^ own >> np.uint64(32)).astype(np.uint32)
    least = np.full(MARKS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(members), 128):  # so many products stay in a core's cache
        hashes = members[at : at + 128, None] * factors
        hashes += terms
        np.minimum(least, hashes.min(axis=0), out=least)
    return np.packbits(least >> np.uint32(2) & np.uint32(1)).tobytes()


SKETCHED = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("marks", pa.binary()), *[(f"s{i}", pa.int64()) for i in range(WORDS)]])
ITEMS = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("row", pa.int64()), ("free", pa.int32()), ("class", pa.int64()), ("n", pa.int32()), ("marks", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("certain", pa.bool_())])
SETS = pa.schema([("row", pa.int64()), ("members", pa.list_(pa.int64()))])
PACKED = pa.schema([("row", pa.int64()), ("members", pa.binary())])
ITEM_COLUMNS = "cell long, fp long, row long, free int, class long, n int, marks binary"


def sketches(batches, k: int):
    for batch in batches:
        rows = []
        for row, text in zip(batch.column("row").to_pylist(), values(batch, "text"), strict=True):
            own = shingle_set(text or "", k)
            rows.append((row, xxhash.xxh3_128_digest(own.tobytes()), len(own), marks(own), *sketch(own)))
        yield record(SKETCHED, **{n: [r[i] for r in rows] for i, n in enumerate(SKETCHED.names)})


def short_cells(batches, prefix: int):
    """Each table's fingerprint of each set, for each prefix that a variant can have, with the flips left for the other bits."""
    flips = masks(prefix, NEAR // 2)
    free = (NEAR // 2 - np.bitwise_count(flips)).astype(np.int32)
    powers = np.uint64(1) << np.arange(SHORT - 1, -1, -1, dtype=np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            some = batch.slice(at, 5_000)
            words = np.stack([some.column(f"s{i}").to_numpy(zero_copy_only=False) for i in range(WORDS)], axis=1)
            bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)
            which = pa.array(np.repeat(np.arange(some.num_rows), len(flips)))
            told = {c: some.column(c).take(which) for c in ("row", "class", "n", "marks")}
            for t in range(TABLES):
                fp = bits[:, t * SHORT : (t + 1) * SHORT].astype(np.uint64) @ powers
                cell = ((fp >> np.uint64(SHORT - prefix))[:, None] ^ flips[None, :]).ravel().astype(np.int64) | t << SHORT
                yield record(ITEMS, cell=cell, fp=np.repeat(fp.astype(np.int64), len(flips)), free=np.tile(free, len(fp)), **told)


class Cell:
    """The items of one cell, in the order of their rows."""

    def __init__(self, held: list[tuple], prefix: int, similarity: float):
        fp, row, free, kind, n, told, *more = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(row, kind="stable")
        self.fp, self.row, self.free, self.kind, self.n, self.told = fp[order].view(np.uint64), row[order], free[order], kind[order], n[order], told[order]
        self.members = more[0][order] if more else None
        self.bits, self.similarity = SHORT - prefix, similarity

    def sifted(self, a, b):
        """Pairs of different classes that sizes and marks don't rule out, and their marks in common."""
        fits = (self.kind[a] != self.kind[b]) & (np.minimum(self.n[a], self.n[b]) >= self.similarity * np.maximum(self.n[a], self.n[b]) - 1e-9)
        a, b = np.minimum(a, b)[fits], np.maximum(a, b)[fits]
        agree = np.concatenate([np.zeros(0, np.int64), *(MARKS - np.bitwise_count(self.told[a[k : k + 50_000]] ^ self.told[b[k : k + 50_000]]).sum(axis=1, dtype=np.int64) for k in range(0, len(a), 50_000))])
        fits = agree >= LEAST
        return a[fits], b[fits], agree[fits]

    def nearest(self):
        """For each row only the one before it that agrees in most marks, of its neighbours in each variant."""
        best = np.full(len(self.row), -1)
        for a, b in collisions(self.fp, self.free, self.bits):
            near = np.bitwise_count(self.fp[a] ^ self.fp[b]) <= NEAR
            a, b, agree = self.sifted(a[near], b[near])
            np.maximum.at(best, b, agree << 40 | a)
        found = np.flatnonzero(best >= 0)
        return best[found] & ((1 << 40) - 1), found, best[found] >> 40

    def across(self):
        """All pairs of different classes within the radius, before they are sifted; a pair may come more than once."""
        kind, fp = self.kind, self.fp
        if (kind == kind[0]).all():
            return
        own, at, count = np.unique(fp, return_index=True, return_counts=True)
        rows = np.split(np.argsort(fp, kind="stable"), np.cumsum(count)[:-1])
        least, most = (np.array([f(kind[r]) for r in rows]) for f in (np.min, np.max))
        for f in np.flatnonzero(least < most):
            yield from between(kind, rows[f], None, self.told)
        for a, b in ball_pairs(own, self.free[at], np.where(least == most, least, -1), self.bits):
            differ = (np.bitwise_count(own[a] ^ own[b]) <= NEAR) & (np.minimum(least[a], least[b]) < np.maximum(most[a], most[b]))
            a, b = a[differ], b[differ]
            single = (count[a] == 1) & (count[b] == 1)
            if single.any():
                yield at[a[single]], at[b[single]]
            for x, y in zip(a[~single].tolist(), b[~single].tolist(), strict=True):
                for i, j in between(kind, rows[x], rows[y], self.told):
                    apart = fp[i] != fp[j]  # those of one fingerprint have met
                    yield i[apart], j[apart]


def cells_of(batches, prefix: int, similarity: float):
    """Rows come sorted by cell: each cell by itself, with its number."""
    cell, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, *own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ITEMS.names[:-1])
        own.append(np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint64).reshape(batch.num_rows, -1))
        if "members" in batch.schema.names:
            own.append(batch.column("members").to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and cells[a] != cell:
                yield cell, Cell(held, prefix, similarity)
                held = []
            cell = cells[a]
            held.append(tuple(c[a:b].copy() for c in own))
    if held:
        yield cell, Cell(held, prefix, similarity)


def colliding(batches, prefix: int, nearest: bool, similarity: float):
    """Rows come sorted by cell. Pairs of different classes whose fingerprints are within the radius and whose sizes and
    marks don't rule them out: of each cell all of them, whatever the order of rows. ``nearest``: for each row only the one
    before it that agrees in most marks in this cell, of its neighbours in each variant.
    """
    for _, of in cells_of(batches, prefix, similarity):
        for a, b, agree in [of.nearest()] if nearest else (of.sifted(*pair) for pair in of.across()):
            if len(a):
                yield record(PAIRS, a=of.row[a], b=of.row[b], certain=agree >= CERTAIN)


def meeting(batches, prefix: int, similarity: float):
    """Rows come sorted by cell. The items of each cell that have a pair by ``colliding``, each once, however many pairs."""
    for cell, of in cells_of(batches, prefix, similarity):
        met = np.zeros(len(of.row), bool)
        for a, b in of.across():
            new = ~(met[a] & met[b])
            a, b, _ = of.sifted(a[new], b[new])
            met[a] = met[b] = True
        own = np.flatnonzero(met)
        for at in range(0, len(own), 20_000):
            k = own[at : at + 20_000]
            yield record(ITEMS, cell=np.full(len(k), cell), fp=of.fp[k].view(np.int64), row=of.row[k], free=of.free[k], n=of.n[k], marks=[m.tobytes() for m in of.told[k]], **{"class": of.kind[k]})


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, in order, are that similar."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def decided(batches, prefix: int, similarity: float):
    """Rows come sorted by cell, with their sets (``members``). Similar rows of different classes, as a forest: pairs that others
    of the cell join already are left, so a cell has fewer links than rows.
    """
    for _, of in cells_of(batches, prefix, similarity):
        forest, sets, links = Forest(), [np.frombuffer(m, np.uint64) for m in of.members], []
        for pair in of.across():
            a, b, agree = of.sifted(*pair)
            order = np.argsort(-agree, kind="stable")
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                one, other = int(of.kind[x]), int(of.kind[y])
                if forest.root(one) != forest.root(other) and alike(sets[x], sets[y], similarity):
                    forest.link(one, other)
                    links.append((x, y))
        if links:
            yield record(EDGES, a=of.row[[x for x, _ in links]], b=of.row[[y for _, y in links]])


def member_sets(batches, k: int):
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), values(batch, "text"), strict=True):
            yield record(SETS, row=[row], members=[shingle_set(text or "", k).view(np.int64)])


def packed_sets(batches, k: int):
    """As ``member_sets``, 8 bytes a member."""
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), values(batch, "text"), strict=True):
            yield record(PACKED, row=[row], members=[shingle_set(text or "", k).tobytes()])


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar, but for those that others join already.

    What is alike for certain makes classes, and the sets of the other pairs between different classes decide.
    """
    met = written(pairs.groupBy("a", "b").agg(F.bool_or("certain").alias("certain")))
    certain = met.filter("certain").select("a", "b")
    classes = written(components(certain))
    of = lambda x: classes.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    unsure = written(met.filter("NOT certain").join(of("a"), "a", "left").join(of("b"), "b", "left").filter("NOT coalesce(ca = cb, false)").select("a", "b"))
    asked = unsure.select(F.col("a").alias("row")).union(unsure.select("b")).distinct()
    sets = written(rows.join(asked, "row", "left_semi").mapInArrow(task(__name__, "member_sets", k=shingle), "row long, members array<long>"))
    member = lambda x: sets.select(F.col("row").alias(x), F.col("members").alias(f"m{x}"))
    both = unsure.join(member("a"), "a").join(member("b"), "b").withColumn("n", F.size(F.array_intersect("ma", "mb")))
    alike = both.filter(F.col("n") >= similarity * (F.size("ma") + F.size("mb") - F.col("n")) - 1e-9).select("a", "b")
    out = written(certain.unionByName(alike))
    for made in (met, classes, unsure, sets):
        dropped(made)
    return out


def similar_links(docs: DataFrame, row: str, text: str = "text", shingle: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Texts with the same shingles (``row, first``), and links ``a, b`` between the first rows of similar sets.

    Similarity is that of Jaccard over sets of ``shingle`` words. Sets that collide in no table are missed (see the
    constants, which are for a similarity of 0.8 and more); no pair below it is linked, but for the error of ``CERTAIN``.
    First each set meets its nearest one in each cell, which joins dense groups with few pairs; then all that collide and
    aren't joined yet. Of these no pairs are made: the sets of the rows that have any go where they meet, and a cell hands on
    a forest. Links stand for their components.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = written(rows.mapInArrow(task(__name__, "sketches", k=shingle), ", ".join(["row long", "digest binary", "n int", "marks binary", *(f"s{i} long" for i in range(WORDS))])))
    distinct = written(made.groupBy("digest").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("marks").alias("marks"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(WORDS)]))
    same = written(made.select("row", "digest").join(distinct.select("digest", F.col("row").alias("first")), "digest").select("row", "first"))
    dropped(made)
    variants = max(1, distinct.count()) * sum(comb(SHORT, i) for i in range(NEAR // 2 + 1))
    prefix = min(24, max(0, round(log2(variants / SHORT_CELL)) if variants > SHORT_CELL else 0))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TABLES)

    def by_cell(items: DataFrame, function: str, schema: str, **settings) -> DataFrame:
        return items.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(task(__name__, function, prefix=prefix, similarity=similarity, **settings), schema)

    def items(sets: DataFrame) -> DataFrame:
        return sets.drop("digest").mapInArrow(task(__name__, "short_cells", prefix=prefix), ITEM_COLUMNS)

    near = verified(by_cell(items(distinct.withColumn("class", F.col("row"))), "colliding", "a long, b long, certain boolean", nearest=True), rows, shingle, similarity)
    classes = written(components(near))
    joined = distinct.join(classes.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("class", F.coalesce("component", "row")).drop("component")
    met = written(by_cell(items(joined), "meeting", ITEM_COLUMNS))
    sets = rows.join(met.select("row").distinct(), "row", "left_semi").mapInArrow(task(__name__, "packed_sets", k=shingle), "row long, members binary")
    rest = written(by_cell(met.join(sets, "row"), "decided", "a long, b long"))
    links = written(near.unionByName(rest))
    for table in (distinct, classes, near, met, rest):
        dropped(table)
    return same, links


def similar_kept(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The row of the least ``key`` of each group of texts that similar ones join, with all its columns.

    Of rows of one key (repeated or null; nulls come first) the first as ``docs`` has them. ``docs`` must be read the same
    each time, as a written table is. A null text is one without words; all of these are alike. Columns of any name pass
    through; an empty table gives an empty one.
    """
    (row,) = fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    same, links = similar_links(rows, row, text, shingle, similarity)
    joined = components(links).withColumnRenamed("node", "first")
    member = same.join(joined, "first", "left").select("row", F.coalesce("component", "first").alias("g"))
    member = written(member.join(rows.select(F.col(row).alias("row"), F.col(key).alias("key")), "row"))
    least = grouped_back(member, "g", F.min(F.struct("key", "row")), "least", member.count())
    gone = written(least.filter("row <> least.row").select(F.col("row").alias(row)))
    for made in (same, links, member):
        dropped(made)
    return rows.join(gone, row, "left_anti").drop(row)


def deduplicated(docs: DataFrame, text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The first row of each group of near-duplicates, with all its columns.

    ``docs`` must have its rows in the same order each time it is read, as a written table has. A null text counts as
    one without words. Columns of any name pass through; an empty table gives an empty one.
    """
    (row,) = fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    first = near_duplicates(rows, row, text, shingle, radius).filter("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(first, row, "left_semi").drop(row)
