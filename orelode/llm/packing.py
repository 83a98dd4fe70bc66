"""Lexical retrieval packing: windows filled with what a sharded BM25 index finds near their seed.

Texts are encoded once into a table in the shared folder. A document's full windows are sequences by themselves. Its
rest goes to a shard: rests are dealt by range of their rarest tokens (those of the highest ids, as a BPE vocabulary
lists merges from frequent to rare), with the row as the last key, so partitions are even whatever documents have in
common. Each ``SHARD`` rests in that order are a shard with its own inverted index of BM25 weights, with document
frequencies and lengths of the whole corpus. It takes unused rests in turn as seeds; the index returns the unused
neighbours by score, which fill the seed's window. The last one is cut; what is left of it is the next seed. So only a
partition's last window has padding.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orelode.llm.runtime import Sink, column, let_go, task, values, written
from orelode.llm.tokens import encoder, unpack

WINDOW, SHARD = 2048, 2_000
K1, B = 1.2, 0.75
#: A term that more than one in so many documents of a shard has is common there.
COMMON = 8
TOKENS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rarest", pa.int32()), ("next_rarest", pa.int32()), ("first_window", pa.int64()), ("full", pa.binary()), ("rest", pa.binary()), ("frequencies", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_COLUMNS = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of full windows start here; those of shards are below.
FULL = 1 << 62


def distinct(ids: np.ndarray) -> np.ndarray:
    """Distinct ids in order."""
    own = np.sort(ids)
    return own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def tokenize(batches, path: str, window: int, end: int | None, kind: str):
    """A row for each document; at the end one with the task's document frequencies, of the vocabulary's size."""
    enc, sink, base = encoder(path), Sink(TOKENS), TaskContext.get().partitionId() << 36
    tail, row, windows = b"" if end is None else end.to_bytes(4, "little"), 0, 0
    counts = np.zeros(enc.size + 1, np.int64)
    for batch in batches:
        for doc, text in zip(column(batch, "doc_id"), values(batch, "text"), strict=True):
            ids = unpack(enc.encode(text or "") + tail).astype(kind)
            terms = distinct(ids)
            counts[terms] += 1
            k = len(ids) // window
            top = terms[-2:].tolist()
            full, rest = ids[: k * window].tobytes(), ids[k * window :].tobytes()
            if sink.add((base + row, doc, len(ids), *([-1, -1] + top)[: -3 : -1], base + windows, full, rest, None), len(full) + len(rest) + 100):
                yield from sink.flush()
            row, windows = row + 1, windows + k
    if row:
        sink.add((None, None, None, None, None, None, None, None, counts.tobytes()))
    yield from sink.flush()


def frequencies(batches):
    for batch in batches:
        for raw in column(batch, "frequencies"):
            counts = np.frombuffer(raw, np.int64)
            terms = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"term": terms.astype(np.int32), "n": counts[terms]})


def full_windows(batches, window: int, kind: str):
    sink, step = Sink(PIECES), window * np.dtype(kind).itemsize
    for batch in batches:
        for doc, n, first, full in zip(*(values(batch, c) for c in ("doc_id", "n", "first_window", "full")), strict=True):
            for k in range(len(full) // step):
                ids = np.frombuffer(full, kind, window, k * step).astype("<u4").tobytes()
                if sink.add((doc, k * window, window, ids, n, FULL + first + k, 0), len(ids) + 64):
                    yield from sink.flush()
    yield from sink.flush()


class Index:
    """BM25 postings of one shard."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, average: float, terms: int | None = None):
        length = np.array([len(r) for r in rests])
        small = len(rests) < 1 << 15 and len(idf) <= 1 << 16
        wide, bits = (np.int32, 16) if small else (np.int64, 32)
        keys = np.sort(np.repeat(np.arange(len(rests), dtype=wide) << bits, length) | np.concatenate(rests).astype(wide))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        doc, term, tf = keys[first] >> bits, keys[first] & (1 << bits) - 1, np.diff(np.concatenate([first, [len(keys)]])).astype(np.float64)
        self.own_weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        self.terms, self.own_term, self.own_first = terms, term, np.searchsorted(doc, np.arange(len(rests) + 1)).tolist()
        order = np.argsort(term.astype(np.uint16) if small else term, kind="stable")
        self.doc, self.weight, own = doc[order], self.own_weight[order], term[order]
        self.first = np.searchsorted(own, np.arange(len(idf) + 1))
        common = np.flatnonzero(np.diff(self.first) * COMMON > len(rests))
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), len(rests)), np.float32)  # weights of the common terms in each document
        whole = self.row[own] >= 0
        self.table[self.row[own[whole]], self.doc[whole]] = self.weight[whole]
        self.live = np.arange(len(rests))  # the documents that columns and postings are of

    def drop(self, used: np.ndarray) -> None:
        """Leaves used documents out of the index."""
        keep = ~used[self.live]
        place = np.cumsum(keep) - 1
        left = keep[self.doc]
        self.first = np.concatenate([[0], np.cumsum(left)])[self.first]
        self.doc, self.weight, self.table, self.live = place[self.doc[left]], self.weight[left], self.table[:, keep], self.live[keep]

    def query(self, doc: int) -> np.ndarray:
        """The terms of a document; with a number of terms those of most weight."""
        a, b = self.own_first[doc], self.own_first[doc + 1]
        if self.terms is None:
            return self.own_term[a:b]
        own = self.own_weight[a:b]
        best = np.argpartition(-own, self.terms - 1)[: self.terms] if b - a > self.terms else np.arange(b - a)
        return self.own_term[a:b][best]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of the live documents for a document's terms: common terms by rows of the table, others by their postings."""
        asked = self.query(doc)
        row = self.row[asked]
        rare = asked[row < 0]
        first = self.first[rare]
        many = self.first[rare + 1] - first
        total = np.cumsum(many)
        at = np.arange(total[-1] if len(rare) else 0) + np.repeat(first - total + many, many)
        return np.bincount(self.doc[at], self.weight[at], len(self.live)) + self.table[row[row >= 0]].sum(axis=0, dtype=np.float32)


def neighbours(index: Index, seed: int, used: np.ndarray):
    """Unused documents by score, best first (ties in order); only those with a term in common."""
    gone = used[index.live]
    if 2 * np.count_nonzero(gone) > len(gone):
        index.drop(used)
        gone = np.zeros(len(index.live), bool)
    live, scores = index.live, index.scores(seed)
    scores[gone] = 0
    found, top = np.flatnonzero(scores), 8
    while len(found):
        if len(found) > 4 * top:
            edge = np.partition(scores[found], len(found) - top)[len(found) - top]
            best = found[scores[found] >= edge]
        else:
            best = found
        best = best[np.argsort(-scores[best], kind="stable")]
        yield from live[best].tolist()
        scores[best] = 0
        found, top = found[scores[found] > 0], top * 4


def fill(sizes: list[int], index: Index, window: int, offset: int = 0):
    """(document, start, length, window, offset) of each piece; ``offset`` of the first window is taken already."""
    used, turn, number = np.zeros(len(sizes), bool), 0, 0
    held: tuple[int, int] | None = None  # a document that was cut, and where

    def unused():
        nonlocal turn
        while turn < len(sizes) and used[turn]:
            turn += 1
        return turn if turn < len(sizes) else None

    while held or unused() is not None:
        seed, start = held or (unused(), 0)
        used[seed], held, near = True, None, None
        doc = seed
        while doc is not None:
            length = min(sizes[doc] - start, window - offset)
            yield doc, start, length, number, offset
            offset += length
            if start + length < sizes[doc]:
                held = doc, start + length
            if offset == window:
                break
            if near is None:
                near = neighbours(index, seed, used)
            doc, start = next((d for d in near if not used[d]), None), 0
            if doc is None:
                doc = unused()
            if doc is not None:
                used[doc] = True
        number, offset = number + 1, 0


def pack_shards(batches, idf, window: int, kind: str, terms: int | None, shard: int):
    """A partition's rows come sorted; each ``shard`` of them in turn is a shard, which goes on in the last one's window."""
    let_go(f"{__name__}.pack_shards")  # all texts are encoded by now
    sink, base, taken, held = Sink(PIECES), TaskContext.get().partitionId() << 32, 0, []

    def pack():
        nonlocal base, taken
        weights, average = idf.value
        rests = [np.frombuffer(rest, kind) for _, _, rest in held]
        for d, start, length, number, offset in fill([len(r) for r in rests], Index(rests, weights, average, terms), window, taken):
            doc, n, _ = held[d]
            if sink.add((doc, n - len(rests[d]) + start, length, rests[d][start : start + length].astype("<u4").tobytes(), n, base + number, offset), 4 * length + 64):
                yield from sink.flush()
        base, taken = (base + number, offset + length) if offset + length < window else (base + number + 1, 0)

    for batch in batches:
        for row in zip(*(column(batch, c) for c in ("doc_id", "n", "rest")), strict=True):
            held.append(row)
            if len(held) == shard:
                yield from pack()
                held = []
    if held:
        yield from pack()
    yield from sink.flush()


def packed(docs: DataFrame, path: str, window: int = WINDOW, end: int | None = None, key: str = "doc_id", text: str = "text", shard: int = SHARD, terms: int | None = None) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    Pieces of a sequence lie side by side from offset 0; ``ids`` are packed (32-bit); ``end`` is added to each document.
    A null text counts as empty: a document without ids has no piece. Repeated rows are documents each; null keys stay;
    other columns go; an empty table gives an empty one. A seed asks for all its terms, or for the ``terms`` of most weight.
    """
    spark = docs.sparkSession
    size = Tokenizer.from_file(path).get_vocab_size()
    kind = "<u2" if max(size, end or 0) < 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = written(rows.mapInArrow(task(__name__, "tokenize", path=path, window=window, end=end, kind=kind), "row long, doc_id long, n long, rarest int, next_rarest int, first_window long, full binary, rest binary, frequencies binary"))
    tokens = made.filter("row IS NOT NULL")
    total, rests, ids = tokens.agg(F.count(F.lit(1)), F.count_if(F.octet_length("rest") > 0), F.sum("n")).first()
    counts = np.zeros(size + 1)
    for r in made.filter("row IS NULL").select("frequencies").mapInArrow(task(__name__, "frequencies"), "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each id of the vocabulary at most
        counts[r[0]] = r[1]
    idf = spark.sparkContext.broadcast((np.log1p((total - counts + 0.5) / (counts + 0.5)), max(1.0, (ids or 0) / max(1, total))))
    whole = tokens.filter(F.octet_length("full") > 0).select("doc_id", "n", "first_window", "full").mapInArrow(task(__name__, "full_windows", window=window, kind=kind), PIECE_COLUMNS)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.filter(F.octet_length("rest") > 0).select("doc_id", "n", "rest", "rarest", "next_rarest", "row").repartitionByRange(max(1, min(ceil(rests / shard), partitions)), "rarest", "next_rarest", "row").sortWithinPartitions("rarest", "next_rarest", "row")
    parts = dealt.select("doc_id", "n", "rest").mapInArrow(task(__name__, "pack_shards", idf=idf, window=window, kind=kind, terms=terms, shard=shard), PIECE_COLUMNS)
    return whole.unionByName(parts)
