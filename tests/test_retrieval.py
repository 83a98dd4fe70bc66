"""Extraction and retrieval from end to end on a small corpus."""

import pytest
from pyspark.sql import functions as F

from orelode.operators import context as C
from orelode.operators import extraction as X
from orelode.operators import mapping as M
from orelode.operators import query_planning as Q
from orelode.operators import retrieval as R

RULES = [("r1", '{"selection": {"Image|endswith": ["\\\\cmd.exe", "x"], "DestinationIp": "10.0.0.1"}}', 'process.name:(cmd or sh) and made.up:"', ["attack.t1059", " "], "High", "see https://e.org 1.2.3.4")]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "rule_id string, detection string, query string, tags array<string>, severity string, authors string")


def test_extraction(rules):
    got = {(r.extractor, r.entity_type, r.value, r.location) for r in X.extracted(rules).collect()}
    assert ("process", "executable", "\\cmd.exe", "detection.selection.Image|endswith[0]") in got
    assert ("process", "process", "cmd", "detection.query[0]") in got and ("process", "process", "sh", "detection.query[0][1]") in got
    assert ("field", "field_modifier", "endswith", "detection.selection.Image|endswith[1]") in got
    assert ("field", "field", "made.up", "detection.query") in got
    assert ("network", "ip_address", "10.0.0.1", "detection.selection.DestinationIp") in got
    assert sum(v == "10.0.0.1" for _, _, v, _ in got) == 1  # the shape scan leaves out fields with a route
    assert ("metadata", "tag", "attack.t1059", "tags") in got and not any(v == " " for _, _, v, _ in got)
    assert X.present_types(X.extracted(rules)).first().types[:2] == ["executable", "process"]
    assert {r.entity_type for r in X.extracted(rules, ("tag",)).collect()} == {"tag"}


@pytest.fixture
def corpus(spark):
    chunks = spark.createDataFrame([("m1:d:001", "m1", "mitre", "description", "T1059 command interpreter cmd", 0), ("m2:d:001", "m2", "mitre", "description", "a parent of things", 0), ("s1:q:001", "s1", "sigma", "query", "process.name cmd rule", 0), ("e1:f:001", "e1", "ecs", "field", "process.name is a field", 0), ("z:s:001", "z", "sigma", "summary", "nothing in common", 0)], "chunk_id string, record_id string, source string, section string, text string, chunk_ord int")
    nodes = spark.createDataFrame([("t", "m1", "T1059", "Interpreter"), ("p", "m2", "TA0002", "Execution"), ("s", "s1", "rule-1", "Cmd rule"), ("e", "e1", "process.name", "process.name")], "node_id string, record_id string, canonical_id string, name string")
    edges = spark.createDataFrame([("s-t", "detects", "s", "t"), ("t-p", "belongs_to", "t", "p")], "key string, type string, start_id string, end_id string")
    return chunks, nodes, edges


def queries(spark, sources=()):
    return spark.createDataFrame([("q", "cmd", ["T1059"], ["process.name"], [], list(sources), [])], "query_id string, text string, entity_ids array<string>, canonical_fields array<string>, lexical_fields array<string>, sources array<string>, sections array<string>")


def test_hybrid(spark, corpus):
    chunks, nodes, edges = corpus
    got = R.retrieved(queries(spark), chunks, nodes, edges, ("node_id", "canonical_id", "name")).orderBy("rank").collect()
    assert [r.chunk_id for r in got][0] == "m1:d:001" and {r.chunk_id for r in got} == {"m1:d:001", "m2:d:001", "s1:q:001", "e1:f:001"}
    first = got[0]
    assert first.score_exact == first.score_graph == first.score_distance == first.score_entity == 1 and 0 < first.score_lexical < 1
    hops = {r.chunk_id: [e.hops for e in r.evidence if e.method == "graph"] for r in got}
    assert hops == {"m1:d:001": [0], "e1:f:001": [0], "s1:q:001": [1], "m2:d:001": [1]}
    only = R.retrieved(queries(spark, ["sigma"]), chunks, nodes, edges, ("node_id", "canonical_id", "name")).collect()
    assert {r.source for r in only} == {"sigma"} and len(only) == 1
    by = R.modes(queries(spark), chunks, nodes, edges, ("node_id", "canonical_id", "name")).groupBy("mode").count().collect()
    assert {r.mode: r["count"] for r in by} == {"text": 3, "graph": 4, "hybrid": 4}
    with pytest.raises(Exception, match="states nothing"):
        R.checked(queries(spark).withColumns({"text": F.lit(" "), "entity_ids": F.array().cast("array<string>"), "canonical_fields": F.array().cast("array<string>")})).collect()


def test_package(spark, corpus):
    chunks, nodes, edges = corpus
    got = R.retrieved(queries(spark), chunks, nodes, edges, ("node_id", "canonical_id", "name"))
    items = C.packaged(C.evidence_items(got, chunks))
    rows = items.orderBy("place").collect()
    assert [r.section for r in rows] == ["graph"] * 4 and rows[0].item_id == "graph:0001" and C.problems(items).count() == 0
    small = C.packaged(C.evidence_items(got, chunks), total_limit=48).collect()
    assert sum(len(r.text) for r in small) <= 48 and any(r.truncated for r in small)
    reports = R.graph_route(queries(spark).withColumn("entity_ids", F.array(F.lit("T1086"), F.lit("T9999"))), chunks, nodes, edges, ("node_id", "canonical_id", "name"))[1]
    assert {r.code for r in C.seed_warnings(reports).collect()} == {"unresolved_seed"}


def test_rule_to_query(spark, rules):
    mapped = M.mapped(X.extracted(rules))
    got = Q.rule_queries(mapped, Q.documented_fields(spark.createDataFrame([("process.executable",), ("process.name",)], "field_name string"))).first()
    assert list(got.entity_ids) == ["T1059"] and list(got.canonical_fields) == ["process.executable", "DestinationIp", "process.name"] and list(got.lexical_fields) == ["Image", "DestinationIp", "process.name"]
