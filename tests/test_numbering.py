import random

import pytest
from pyspark.sql import functions as F

from orelode.operators.numbering import numbered
from orelode.session import shared_folder


def test_like_a_window(spark):
    random.seed(3)
    rows = [(random.choice(["a", "a", "a", "b", None, "é"]), random.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, tie int").repartition(7)
    out = numbered(df, ["g"], [F.desc("v"), "tie"], "nth").collect()
    want = {}
    for g in {r[0] for r in rows}:
        want |= {r: n for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    assert {(r.g, r.v, r.tie): r.nth for r in out} == want
    whole = numbered(df, [], ["tie"], "nth").collect()
    assert all(r.nth == r.tie for r in whole) and len(whole) == 3000


def test_copies_and_names(spark):
    df = spark.range(2000).select(F.lit("x").alias("part"), F.lit(1).alias("place"))
    out = numbered(df, ["part"], ["place"], "nth")
    assert out.columns == ["part", "place", "nth"]
    assert sorted(r.nth for r in out.collect()) == list(range(2000))
    assert out.sparkSession.createDataFrame([], "g string, v int").transform(lambda d: numbered(d, ["g"], ["v"], "n")).count() == 0


def test_many_partitions_for_one_group(spark):
    """No exchange deals rows by the group."""
    df = spark.range(100).select(F.lit(1).alias("g"), "id")
    plan = numbered(df, ["g"], ["id"], "nth")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank(" not in plan


def test_shared_folder(spark):
    assert shared_folder(spark).startswith("file://")

    class Context:
        master = "spark://a:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {"spark.sql.warehouse.dir": "file:/tmp/w"}

    Session.conf = type("C", (), {"get": lambda self, k, d=None: {"spark.sql.warehouse.dir": "file:/tmp/w"}.get(k, d)})()
    with pytest.raises(RuntimeError):
        shared_folder(Session())
