"""BPE encoding and decoding of whole texts; long texts by tree concatenation.

A text of at most ``long`` characters is encoded in one piece. A longer one is cut in halves, and these again, down to
``leaf`` characters; tasks encode the leaves in parallel, whatever they cut through. Neighbours are then joined as a
tree: a growing window around each join is encoded anew until its pre-tokens agree exactly with those of both sides.
Inside a pre-token that is cut (a long run without a split), the window is one of tokens: any two neighbours in a valid
BPE sequence are a valid sequence by themselves, so once the window shares a token with either side, the joined
sequence is the only valid one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import Sink, column, task, values
from orelode.llm.tokens import UNSURE, Encoder, byte_level, encoder, unpack

LEAF, LONG = 16_384, 32_768
#: More characters than either splitter looks ahead.
AHEAD = 4
#: Cut pre-tokens of more characters are joined by their tokens, others are encoded anew.
SPLICE = 512
DONE = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
CUT = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("leaf", pa.int32()), ("segment", pa.int32()), ("special", pa.int64()), ("text", pa.string())])
LEAVES = pa.schema([*CUT, ("starts", pa.binary()), ("ends", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])


class Run(NamedTuple):
    """Pre-tokens of a stretch of text: where each starts and ends in its segment, its number of ids, and all ids."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    def part(self, a: int, b: int) -> Run:
        at = np.concatenate([[0], np.cumsum(self.counts)])
        return Run(self.starts[a:b], self.ends[a:b], self.counts[a:b], self.ids[at[a] : at[b]])


def run_of(starts, ends, packed: list[bytes]) -> Run:
    return Run(np.array(starts, np.int64), np.array(ends, np.int64), np.array([len(x) // 4 for x in packed], np.int64), np.frombuffer(b"".join(packed), "<u4"))


def chained(runs: list[Run]) -> Run:
    return Run(*(np.concatenate(x) for x in zip(*runs, strict=True)))


def lengths(enc: Encoder) -> np.ndarray:
    """Bytes of text that each id of the vocabulary stands for."""
    if not hasattr(enc, "token_bytes"):
        out = np.zeros(enc.size + 1, np.int64)
        for token, i in enc.bare.get_vocab(with_added_tokens=False).items():
            out[i] = len(token.removesuffix(enc.suffix) if enc.suffix else token)
        enc.token_bytes = out
    return enc.token_bytes


def spans(enc: Encoder, text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the pre-tokens of normalized text without special tokens."""
    if enc.pieces is not None and not UNSURE.search(text):
        found = [m.span() for m in enc.pieces.finditer(text)]
    else:
        found = [s for _, s in enc.bare.pre_tokenizer.pre_tokenize_str(text)]
    return [a for a, _ in found], [b for _, b in found]


def by_model(enc: Encoder, units: str) -> list[int]:
    return [t.id for t in enc.bare.model.tokenize(units)]


def packed_pieces(enc: Encoder, words: list[str]) -> list[bytes]:
    return [enc.cache[w] if len(w) <= SPLICE else np.array(by_model(enc, byte_level(w)), "<u4").tobytes() for w in words]


def encode_leaf(enc: Encoder, text: str, at: int) -> Run:
    starts, ends = spans(enc, text)
    return run_of([at + a for a in starts], [at + b for b in ends], packed_pieces(enc, [text[a:b] for a, b in zip(starts, ends, strict=True)]))


def splice(enc: Encoder, piece: str, cut: int, left: np.ndarray, right: np.ndarray) -> bytes:
    """The ids of one pre-token from those of its parts before and from character ``cut``."""
    units, size, middle = byte_level(piece), lengths(enc), len(piece[:cut].encode())
    l_ends, r_ends = np.cumsum(size[left]), middle + np.cumsum(size[right])
    l_starts, r_starts = l_ends - size[left], r_ends - size[right]
    n = 8
    while n < max(len(left), len(right)):
        i, j = max(0, len(left) - n), min(len(right), n)
        x, y = int(l_starts[i]) if i else 0, int(r_ends[j - 1])
        ids = np.array(by_model(enc, units[x:y]), "<u4")
        ends = x + np.cumsum(size[ids])
        starts = ends - size[ids]
        had = dict(zip(zip(l_starts[i:-1].tolist(), left[i:-1].tolist(), strict=True), range(i, len(left) - 1), strict=True))
        has = dict(zip(zip(r_starts[:j].tolist(), right[:j].tolist(), strict=True), range(j), strict=True))
        keys = list(zip(starts.tolist(), ids.tolist(), strict=True))
        a = next((k for k, key in enumerate(keys) if key in had), None)
        b = next((k for k in range(len(keys) - 1, -1, -1) if keys[k] in has), None)
        if a is not None and b is not None and a < b:
            return np.concatenate([left[: had[keys[a]]], ids[a:b], right[has[keys[b]] :]]).astype("<u4").tobytes()
        n *= 2
    return np.array(by_model(enc, units), "<u4").tobytes()


def join(enc: Encoder, text: str, left: Run, right: Run, low: int, cut: int, high: int) -> Run:
    """The pre-tokens of text[low:high] from those of its halves, where a window over the cut agrees with both."""
    w = 64
    while True:
        i = max(0, int(np.searchsorted(left.starts, max(low, cut - w), "right")) - 1)
        s, e = int(left.starts[i]) if len(left.starts) else low, min(high, cut + w)
        if s > cut - w and i == 0:
            s = low
        starts, ends = spans(enc, text[s:e])
        starts, ends = [s + a for a in starts], [s + b for b in ends]
        agree, before = None, s == low
        for a, b in zip(starts, ends, strict=True):  # the left side's first pre-token that the window has as well
            if before or a >= cut:
                break
            j = int(np.searchsorted(left.starts, a))
            before = b <= cut - AHEAD and j < len(left.starts) and left.starts[j] == a and left.ends[j] == b
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if a >= cut and (b <= e - AHEAD or e == high):
                j = int(np.searchsorted(right.starts, a))
                if j < len(right.starts) and right.starts[j] == a and right.ends[j] == b:
                    agree = k, j
                    break
        if before and (agree or e == high):
            break
        w *= 4
    k, j = agree or (len(starts), len(right.starts))
    packed = []
    for a, b in zip(starts[:k], ends[:k], strict=True):
        whole = b - a > SPLICE and a < cut < b and len(left.starts) and len(right.starts) and left.starts[-1] == a and left.ends[-1] == cut and right.starts[0] == cut and right.ends[0] == b
        packed += [splice(enc, text[a:b], cut - a, left.part(len(left.starts) - 1, len(left.starts)).ids, right.part(0, 1).ids)] if whole else packed_pieces(enc, [text[a:b]])
    return chained([left.part(0, i), run_of(starts[:k], ends[:k], packed), right.part(j, len(right.starts))])


def cut_positions(n: int, leaf: int) -> list[int]:
    """Where halving cuts a text of n characters."""
    out, stack = [], [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a > leaf:
            out.append(m := (a + b) // 2)
            stack += [(a, m), (m, b)]
    return [0, *sorted(out), n]


def segments(enc: Encoder, text: str) -> Iterator[tuple[str, int]]:
    """Normalized stretches between special tokens, and (with an id of at least 0) these."""
    at = 0
    for found in enc.special.finditer(text) if enc.special else ():
        yield text[at : found.start()], -1
        yield "", enc.specials[found[0]]
        at = found.end()
    yield text[at:], -1


def tree(enc: Encoder, text: str, runs: list[Run], cuts: list[int]) -> Run:
    """Joins the runs between the cuts, neighbours first."""
    if len(runs) == 1:
        return runs[0]
    m = len(runs) // 2
    return join(enc, text, tree(enc, text, runs[:m], cuts[: m + 1]), tree(enc, text, runs[m:], cuts[m:]), cuts[0], cuts[m], cuts[-1])


def decode(enc: Encoder, ids: list[int]) -> str:
    return enc.library.decode(ids, skip_special_tokens=False)


def encode_short(batches, path: str):
    enc, sink = encoder(path), Sink(DONE)
    for batch in batches:
        for doc, text in zip(column(batch, "doc_id"), values(batch, "text"), strict=True):
            ids = enc.encode(text or "")
            if sink.add((doc, ids, decoded := decode(enc, unpack(ids).tolist())), len(ids) + len(decoded)):
                yield from sink.flush()
    yield from sink.flush()


def cut_long(batches, path: str, leaf: int):
    enc, sink = encoder(path), Sink(CUT)
    for batch in batches:
        for doc, text in zip(column(batch, "doc_id"), values(batch, "text"), strict=True):
            digest, n = hashlib.sha256(text.encode()).digest(), 0
            for segment, (part, special) in enumerate(segments(enc, text)):
                if special < 0 and enc.library.normalizer is not None:
                    part = enc.library.normalizer.normalize_str(part)
                cuts = cut_positions(len(part), leaf)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if sink.add((doc, digest, n, segment, special, part[a:b]), 4 * (b - a) + 100):
                        yield from sink.flush()
                    n += 1
    yield from sink.flush()


def encode_leaves(batches, path: str):
    enc, sink = encoder(path), Sink(LEAVES)
    for batch in batches:
        for row in batch.to_pylist():
            run = encode_leaf(enc, row["text"], 0)
            if sink.add((*(row[c] for c in CUT.names), *(x.tobytes() for x in run[:3]), run.ids.astype("<u4").tobytes()), 12 * len(row["text"]) + 200):
                yield from sink.flush()
    yield from sink.flush()


def whole(enc: Encoder, leaves: list[dict]) -> bytes:
    """The ids of a document from its leaves, in order."""
    out, at = [], 0
    while at < len(leaves):
        to = at
        while to < len(leaves) and leaves[to]["segment"] == leaves[at]["segment"]:
            to += 1
        own = leaves[at:to]
        if own[0]["special"] >= 0:
            out.append(int(own[0]["special"]).to_bytes(4, "little"))
        else:
            cuts = [0, *np.cumsum([len(x["text"]) for x in own]).tolist()]
            runs = [Run(np.frombuffer(x["starts"], np.int64) + a, np.frombuffer(x["ends"], np.int64) + a, np.frombuffer(x["counts"], np.int64), unpack(x["ids"])) for x, a in zip(own, cuts, strict=False)]
            out.append(tree(enc, "".join(x["text"] for x in own), runs, cuts).ids.astype("<u4").tobytes())
        at = to
    return b"".join(out)


def join_leaves(batches, path: str):
    """Rows come sorted by document and leaf; a row that is repeated has each of its leaves as often."""
    enc, sink, key, own, copies = encoder(path), Sink(DONE), None, [], 0

    def done():
        ids = whole(enc, own)
        text = decode(enc, unpack(ids).tolist())
        for _ in range(copies):
            if sink.add((key[0], ids, text), len(ids) + len(text)):
                yield from sink.flush()

    for batch in batches:
        for row in batch.to_pylist():
            now = row["doc_id"], row["digest"]
            if own and now != key:
                yield from done()
                own = []
            key = now
            if own and row["leaf"] == own[-1]["leaf"]:
                copies += row["leaf"] == 0
                continue
            copies = 1 if not own else copies
            own.append(row)
    if own:
        yield from done()
    yield from sink.flush()


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """``doc_id, ids, decoded`` for each row: packed ids (unsigned 32-bit, little-endian) and what they decode to.

    A null text counts as empty and has no ids; a null key stays null; repeated rows stay; other columns go. Special
    tokens in a text become their ids, as is the library's default. An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= long).mapInArrow(task(__name__, "encode_short", path=path), "doc_id long, ids binary, decoded string")
    cut = rows.filter(F.length("text") > long).mapInArrow(task(__name__, "cut_long", path=path, leaf=leaf), "doc_id long, digest binary, leaf int, segment int, special long, text string")
    leaves = cut.repartition("doc_id", "digest", "leaf").mapInArrow(task(__name__, "encode_leaves", path=path), "doc_id long, digest binary, leaf int, segment int, special long, text string, starts binary, ends binary, counts binary, ids binary")
    joined = leaves.repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "leaf").mapInArrow(task(__name__, "join_leaves", path=path), "doc_id long, ids binary, decoded string")
    return short.unionByName(joined)
