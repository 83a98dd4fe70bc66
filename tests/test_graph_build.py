"""A graph from a small corpus with every kind of reference that fails."""

import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import graph as G
from orelode.operators import graph_build as B
from orelode.operators import references as R

RECORDS = [
    ("mitre", 1, "mitre:T1059", "enterprise:T1059", {"objectType": "technique", "techniqueId": "T1059", "techniqueName": "Scripts", "domain": "enterprise", "tactics": [{"tacticId": " ta0002\n"}, "x", {"tacticId": 3}], "url": "http://e.org/1"}),
    ("mitre", 2, "mitre:T1059.001", "enterprise:T1059.001", {"objectType": "technique", "techniqueId": "T1059.001", "parentTechniqueId": "T1059"}),
    ("mitre", 3, "mitre:TA0002", "enterprise:TA0002", {"objectType": "tactic", "id": "TA0002", "name": "Execution"}),
    ("mitre", 4, "mitre:M1013-e", "enterprise:M1013", {"objectType": "mitigation", "id": "M1013"}),
    ("mitre", 5, "mitre:M1013-m", "mobile:M1013", {"objectType": "mitigation", "id": "M1013"}),
    ("mitre", 6, "mitre:odd", "enterprise:T1999", {"objectType": "matrix", "techniqueId": "T1999"}),
    ("mitre", 7, "mitre:noid", "enterprise:x", {"objectType": "technique"}),
    ("sigma", 1, "sigma:1", "s1", {"title": "One", "ruleId": "r1", "mitreTechniques": ["T1059", "T1999", "T4444", "m1013"], "tags": ["attack.t1059.001", "attack.execution", " cve.2021.44228 ", " ", 7], "level": "high"}),
    ("sigma", 2, "sigma:2", "s2", {"title": "Two", "ruleId": "r1"}),
    ("sigma", 3, "sigma:3", "s3", {"mitreTechniques": "T1059"}),
    ("elastic", 1, "elastic:1", "e1", {"ruleName": "E", "mitre": [{"tacticId": "TA0002", "techniqueId": "T1059"}], "maturity": "production", "severity": "low"}),
    ("lolbas", 1, "lolbas:1", "l1", {"binary": "x.exe", "mitreTechnique": ["T1059"], "platform": "windows"}),
    ("ecs", 1, "ecs:1", "process.name", {"fieldName": "process.name", "fieldSet": "process"}),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(s, n, i, sid, "text", json.dumps(m)) for s, n, i, sid, m in RECORDS]
    return spark.createDataFrame(rows, "source string, line_number int, id string, source_id string, text string, m string").withColumn("metadata", F.parse_json("m")).drop("m")


@pytest.fixture(scope="module")
def graph(records):
    return tuple(x.cache() for x in B.built(records))


def test_nodes(graph):
    nodes = {r.node_id: r for r in graph[0].collect()}
    assert set(nodes) == {
        "mitre:technique:enterprise:T1059", "mitre:technique:enterprise:T1059.001", "mitre:tactic:enterprise:TA0002", "mitre:mitigation:enterprise:M1013", "mitre:mitigation:mobile:M1013", "sigma:rule:r1", "sigma:rule:s3", "elastic:rule:e1", "lolbas:lolbas_entry:l1", "ecs:ecs_field:process.name",
        "derived:tag:attack.t1059.001", "derived:tag:attack.execution", "derived:tag:cve.2021.44228", "derived:external_reference:cve:CVE-2021-44228",
    }
    one = nodes["mitre:technique:enterprise:T1059"]
    assert one.properties == {"objectType": "technique", "domain": "enterprise", "attackId": "T1059", "url": "http://e.org/1"} and one.name == "Scripts"
    assert one.evidence == dict(zip(B.NODE_EVIDENCE, ("mitre", "enterprise:T1059", "mitre:T1059", "mitre.jsonl", "1"), strict=True))
    assert nodes["sigma:rule:r1"].name == "One"  # the first of one id
    assert nodes["elastic:rule:e1"].properties == {"category": "elastic", "level": "low", "status": "production"}
    assert nodes["derived:external_reference:cve:CVE-2021-44228"].properties == {"scheme": "cve", "identifier": "CVE-2021-44228", "described": "false"}


def test_edges(graph):
    edges = {r.key: r for r in graph[1].collect()}
    t = "mitre:technique:enterprise:T1059"
    assert {k for k in edges if "has_tag" not in k} == {
        f"{t}|belongs_to|mitre:tactic:enterprise:TA0002|mitre|enterprise:T1059|tactics.tacticId|TA0002",
        f"{t}.001|subtechnique_of|{t}|mitre|enterprise:T1059.001|parentTechniqueId|T1059",
        f"sigma:rule:r1|detects|{t}|sigma|s1|mitreTechniques|T1059",
        f"sigma:rule:r1|references|{t}.001|sigma|s1|tags|T1059.001",
        "sigma:rule:r1|references|derived:external_reference:cve:CVE-2021-44228|sigma|s1|tags|cve.2021.44228",
        f"sigma:rule:s3|detects|{t}|sigma|s3|mitreTechniques|T1059",
        "elastic:rule:e1|belongs_to|mitre:tactic:enterprise:TA0002|elastic|e1|mitre.tacticId|TA0002",
        f"elastic:rule:e1|detects|{t}|elastic|e1|mitre.techniqueId|T1059",
        f"lolbas:lolbas_entry:l1|detects|{t}|lolbas|l1|mitreTechnique|T1059",
    }
    one = edges[f"sigma:rule:r1|detects|{t}|sigma|s1|mitreTechniques|T1059"].evidence
    assert set(one) == set(B.EDGE_EVIDENCE) and one["canonical_id"] == "T1059" and one["evidence"] == "mitre:T1059" and one["source_location"] == "sigma:s1:mitreTechniques"


def test_skipped(graph, records):
    listed = R.listed(graph[2], B.skipped_candidates(records, graph[2]))
    got = {(r.reason, r.source_id, r.original_value, tuple(r.candidates)) for r in listed.collect()}
    assert got == {("target_node_absent", "s1", "T1999", ()), ("unresolved_target", "s1", "T4444", ()), ("ambiguous_target", "s1", "M1013", ("mitre:M1013-e", "mitre:M1013-m")), ("unresolved_target", "enterprise:T1059", "x", ())}
    assert {r.reason: r.n for r in B.diagnostics(graph[2]).collect()} == dict.fromkeys(G.SKIPS, 1) | {"unresolved_target": 2}


def test_valid(graph, spark):
    assert B.problems(*graph).collect() == []
    nodes, edges, skipped = graph
    bad = edges.limit(1).withColumn("evidence", F.map_concat(F.map_filter("evidence", lambda k, _: ~k.isin("resolution_status", "original_value")), F.create_map(F.lit("resolution_status"), F.lit("ambiguous"), F.lit("original_value"), F.lit("M1013"))))
    assert {r.code for r in B.problems(nodes.withColumn("evidence", F.lit(None).cast("map<string,string>")), bad, skipped).collect()} == {"ambiguous_target", "node_without_evidence"}


def test_part_and_store(records, spark, tmp_path):
    nodes, edges, skipped = B.built(records, ("sigma",))
    assert {r.node_type for r in nodes.collect()} == {"rule", "tag", "external_reference"}
    assert {r.note for r in skipped.collect()} == {"no source at hand answers this kind"} and edges.filter("type = 'detects'").count() == 0
    path = str(tmp_path / "graph")
    first = B.stored(records, path, ("sigma",))
    assert first["nodes_added"] == nodes.count() and first["edges_added"] == edges.count() and first["skipped"] == skipped.count()
    whole = B.stored(records, path)
    assert (whole["records_read"], whole["skipped"]) == (13, 4)
    kept, linked = B.stored_graph(records, path)
    full_nodes, full_edges, _ = B.built(records)
    ids = lambda df, c: sorted(r[0] for r in df.select(c).collect())
    assert ids(kept, "node_id") == sorted({*ids(nodes, "node_id"), *ids(full_nodes, "node_id")}) and len(ids(full_nodes, "node_id")) == 14
    assert ids(linked, "key") == sorted({*ids(edges, "key"), *ids(full_edges, "key")}) and len(ids(full_edges, "key")) == 12
    again = B.stored(records, path)
    assert not any(again[f"{n}_{w}"] for n in ("nodes", "edges") for w in ("added", "changed", "written"))
    assert B.built(records.limit(0))[0].collect() == []
    assert {r.record_id: r.source_id for r in B.neighbours_by_record(nodes).collect()} == {"sigma:1": "s1", "sigma:3": "s3"}
