"""Every id in exactly one piece, full windows, and neighbours together."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from orelode.llm import packing
from orelode.llm.tokens import unpack

WORD = P.path("word_bpe_49k.json")


def rows():
    rng = random.Random(8)
    words = "the quick brown fox jumps over a lazy dog while some river runs on and no end of it all".split()
    out = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 90, 300, 900]))) for _ in range(150)]
    out += [None, "", "x" * 3000, "a <|endoftext|> b", *out[:5]]
    return [(i if i % 31 else None, t, "x") for i, t in enumerate(out)]


@pytest.mark.parametrize(("window", "shard", "end"), [(64, 40, 1), (2048, 2000, 1), (128, 7, None)])
def test_pieces(spark, window, shard, end):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, rest string")
    out = packing.packed(docs, WORD, window=window, end=end, shard=shard).collect()
    t = Tokenizer.from_file(WORD)
    want = sorted(((d, tuple(t.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end]))) for d, x, _ in rows()), key=str)
    of = defaultdict(list)
    for r in out:
        assert len(unpack(r.ids)) == r.length > 0
        of[r.doc_id, r.doc_tokens].append(r)
    singles = [(d, ids) for d, ids in want if d is not None and sum(x[0] == d for x in want) == 1]
    for d, ids in singles:
        own = sorted(of[d, len(ids)], key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert tuple(x for r in own for x in unpack(r.ids).tolist()) == ids
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in want)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= window
        short += sum(n for _, n in own) < window
    assert short <= -(-len(want) // shard)
    assert packing.packed(docs.limit(0), WORD, window=window, end=end).collect() == []


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    rests = [rng.integers(100 * (i % 5), 100 * (i % 5) + 60, 50).astype("<u2") for i in range(60)]
    index = packing.Index(rests, np.ones(600), 50.0, 16)
    used = np.zeros(60, bool)
    used[5] = True
    found = list(packing.neighbours(index, 0, used))
    assert 5 not in found and all(d % 5 == 0 for d in found)
    scores = index.scores(0)
    assert [scores[d] for d in found] == sorted((scores[d] for d in range(60) if scores[d] and d != 5), reverse=True)
    windows = defaultdict(set)
    for d, _, _, number, _ in packing.fill([50] * 60, index, 200):
        windows[number].add(d % 5)
    assert np.mean([len(w) for w in windows.values()]) < 1.7


def test_seed_asks_for_all_its_terms():
    idf = np.arange(1.0, 101.0)
    rests = [np.arange(40, 80), np.arange(100)[90:], np.arange(36, 44), np.arange(60, 80)]
    index = packing.Index([r.astype("<u2") for r in rests], idf, 40.0)
    assert list(packing.neighbours(index, 0, np.array([True, False, False, False]))) == [3, 2]
    shared = [sum(index.weight[i] for i in range(index.first[t], index.first[t + 1]) for _ in [0] if index.doc[i] == 2) for t in rests[0]]
    assert np.isclose(index.scores(0)[2], sum(shared))


def plain_scores(rests, idf, average, seed):
    """BM25 by its formula, term by term."""
    out = []
    for r in rests:
        n, total = len(r), 0.0
        for t in set(rests[seed].tolist()):
            tf = int((r == t).sum())
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * n / average)) if tf else 0.0
        out.append(total)
    return np.array(out)


def test_scores_against_the_formula():
    """Common and rare terms, before and after used rests leave the index; and the neighbours that follow."""
    rng = np.random.default_rng(3)
    rests = [np.sort(rng.choice(400, size=rng.integers(1, 80), p=(w := 1 / np.arange(1, 401)) / w.sum())).astype("<u2") for _ in range(90)]
    idf, average = rng.random(500) + 0.1, 40.0
    index, used = packing.Index(rests, idf, average), np.zeros(90, bool)
    for step in range(3):
        for seed in range(0, 90, 7):
            want = plain_scores(rests, idf, average, seed)
            assert np.allclose(index.scores(seed), want[index.live], rtol=1e-5)
            found = list(packing.neighbours(index, seed, used))
            assert set(found) == {d for d in range(90) if want[d] > 0 and not used[d]}
            assert all(want[a] >= want[b] - 1e-4 for a, b in zip(found, found[1:], strict=False))
        used[rng.choice(90, 50, replace=False)] = True
        index.drop(used)
