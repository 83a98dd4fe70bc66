"""Requests, stamps, flattened replies and supplied material."""

import datetime

from pyspark.sql import functions as F

from orelode.operators import requests as Q
from orelode.operators import rule_parsing as P


def test_faults(spark):
    rows = [("a", "analyze", "rule", None, None, None), ("b", "generate", None, "q", "eql", None), ("c", "enhance", None, "q", None, None), ("d", "odd", "r", "q", "eql", " "), ("e", "generate", None, None, None, "do it")]
    got = Q.request_faults(spark.createDataFrame(rows, "request_id string, operation string, rule_text string, query string, language string, requirement string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.request_id, []).append(r.fault)
    assert by == {"b": ["generate needs a requirement"], "c": ["a bare query needs its language"], "d": ["unknown operation", "exactly one subject is needed"]}


def test_stamp(spark):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5, 678999)
    got = spark.createDataFrame([(t, t - datetime.timedelta(seconds=1))], "a timestamp, b timestamp").select(*Q.stamp(F.col("b"), F.col("a")), F.uuid()).first()
    assert got.generated_at.endswith("05.678Z") and got.elapsed_ms == 1000 and len(got.result_id) == 36


def test_replies(spark):
    rows = spark.createDataFrame([("1", '{"score": 5, "items": [{"id": "x"}, null, true], "evidence": ["graph:0001", "e2"]}'), ("2", None)], "request_id string, reply string")
    assert [(r.path, r.value) for r in Q.flattened(rows).orderBy("n").collect()] == [("$.score", "5"), ("$.items[0].id", "x"), ("$.evidence[0]", "graph:0001"), ("$.evidence[1]", "e2")]
    assert [(r.path, r.item_id) for r in Q.citations(rows).collect()] == [("$.evidence[0]", "graph:0001"), ("$.evidence[1]", "e2")]


def test_supplied(spark):
    items = spark.createDataFrame([("p", 2, "i2", "B  b"), ("p", 1, "i1", "A")], "package_id string, place int, item_id string, text string")
    got = Q.supplied(items, spark.createDataFrame([("p", "Rule")], "package_id string, text string")).first()
    assert got.material == "Rule\ni1\nA\ni2\nB  b" and got.folded == "rule i1 a i2 b b"


def test_raw_rules(spark):
    got = P.raw_rules(spark.createDataFrame([("1", "a:b", "KQL"), ("2", " ", "odd")], "rule_id string, query string, language string")).collect()
    assert [(r.language, r.fault) for r in got] == [("kuery", None), ("unknown", "empty query")]
