"""Counts and components against all pairs."""

import numpy as np
import pytest

from orelode.llm import embedding_join
from tests.llm.test_simhash import plain_components


def plain(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = set()
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    links.add((i, j))
    groups, low = plain_components(links, range(len(rows))), {}
    for i, (d, _) in enumerate(rows):
        low[groups[i]] = min((x for x in (low.get(groups[i]), d) if x is not None), default=None)
    n = np.bincount([x for p in links for x in p], minlength=len(rows))
    return [(d, int(n[i]), low[groups[i]], d == low[groups[i]]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [8, 50, 2048])
def test_links(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for size in (3, 16):
        for _ in range(12):
            base = rng.normal(size=size)
            for _ in range(rng.integers(1, 15)):
                rows.append([float(np.float32(x)) for x in base + rng.normal(size=size) * rng.choice([0, 0.01, 0.1, 0.3])])
    rows += [rows[3]] * 20 + [None, [], [0.0] * 16, [1.0, None, 2.0], [float("nan")] * 3, [float("inf"), 1.0, 1.0], [-0.0, 1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 5.0, 0.0]]
    rows = [(i if i != 4 else None, v) for i, v in enumerate(rows)]
    rows.append((0, rows[0][1]))
    got = embedding_join.linked(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int"), block=block).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_dense(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    rows = [(i, [float(x) for x in base + rng.normal(size=32) * 0.004]) for i in range(300)] + [(300 + i, [float(x) for x in rng.normal(size=32)]) for i in range(100)]
    got = embedding_join.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_nothing(spark):
    assert embedding_join.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(r) for r in embedding_join.linked(spark.createDataFrame([(7, None)], "vec_id long, embedding array<float>")).collect()] == [(7, 0, 7, True)]
