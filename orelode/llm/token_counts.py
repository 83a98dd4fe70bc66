"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

The first tier is a table of frequent pre-tokens and their numbers of tokens, of at most ``entries`` rows, which is
broadcast; it comes from at most ``PARTS`` partitions, which count the pre-tokens of their first texts where they are and
send the counts alone. It only decides what is fast: no count depends on it. The second tier is a worker's cache, filled
by the tokenizers library with what the table lacks.
"""

from __future__ import annotations

import pickle
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import record, task, values
from orelode.llm.tokens import LONG_PIECE, Cache, Encoder, encoder

#: Texts that are sampled in all, partitions that they come from, bytes of them in a partition, and rows of the table.
SAMPLE, PARTS, BYTES, ENTRIES = 2_000, 4, 16 << 20, 65_536
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def frequent(batches, path: str, sample: int, entries: int):
    """One row, if there are texts: the most frequent pre-tokens of a partition's first ones, and how often each is there."""
    enc, counts, n, size = encoder(path), Counter(), 0, 0
    for batch in batches:
        for text in values(batch, "text"):
            counts.update(w for w in enc.split(text or "") or () if len(w) <= LONG_PIECE)
            if len(counts) > 16 * entries:
                counts = Counter(dict(counts.most_common(4 * entries)))
            n, size = n + 1, size + len(text or "")
            if n >= sample or size >= BYTES:
                break
        if n >= sample or size >= BYTES:
            break
    if n:
        yield pa.RecordBatch.from_pydict({"counts": pa.array([pickle.dumps(counts.most_common(entries))], pa.binary())})


def table_of(rows: DataFrame, path: str, sample: int, entries: int) -> tuple[bytes, bytes]:
    """The most frequent pre-tokens of some partitions' first texts, and a byte each for their lengths."""
    counted = rows.select("text").mapInArrow(task(__name__, "frequent", path=path, sample=max(1, sample // PARTS), entries=entries), "counts binary")
    counts, enc = Counter(), encoder(path)
    for (part,) in counted.take(PARTS):  # Spark runs partitions until it has so many rows; texts stay where they are
        counts.update(dict(pickle.loads(part)))
    sized = [(w, len(enc.piece(w)) // 4) for w, _ in counts.most_common(entries)]
    sized = [(w, n) for w, n in sized if n < 256]
    return pickle.dumps([w for w, _ in sized]), bytes(n for _, n in sized)


class Lengths(dict):
    """Numbers of tokens of pre-tokens: the broadcast table, then what this worker has met."""

    def __init__(self, enc: Encoder, words: bytes, sizes: bytes, entries: int = 200_000):
        super().__init__(zip(pickle.loads(words), sizes, strict=True))
        self.enc, self.met = enc, Cache(lambda w: len(enc.piece(w)) // 4, entries)

    def __missing__(self, word: str) -> int:
        return self.met[word]

    def count(self, text: str) -> int:
        pieces = self.enc.split(text)
        return len(self.enc.encode(text)) // 4 if pieces is None else sum(map(self.__getitem__, pieces))


_kept: dict[tuple, Lengths] = {}


def count_batches(batches, path: str, table):
    words, sizes = table.value
    key = path, hash(words), hash(sizes)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Lengths(encoder(path), words, sizes)
    lengths = _kept[key]
    for batch in batches:
        got = [(len(t) if t.isascii() else len(t.encode()), lengths.count(t)) for t in (v or "" for v in values(batch, "text"))]
        yield record(COUNTED, doc_id=batch.column("doc_id"), n_bytes=[a for a, _ in got], n_tokens=[b for _, b in got])


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, with ``over_limit`` for more than ``limit`` tokens.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null keys stay, other columns go, and an empty
    table gives an empty one. Special tokens inside a text count as one token each, as is the library's default.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(table_of(rows, path, sample, entries))
    return rows.mapInArrow(task(__name__, "count_batches", path=path, table=table), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
