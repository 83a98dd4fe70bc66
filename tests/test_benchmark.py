"""Relevance by each rule, runs of all modes, safety findings, and an index that is built once."""

import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import benchmark as B
from orelode.operators import chunks as C
from orelode.operators import evaluation as E
from orelode.operators import graph_build as G
from orelode.operators import retrieval as R
from orelode.operators import text_index as X
from orelode.session import settled
from orelode.sources import sinks

RECORDS = [
    ("mitre", "mitre:T1059", "enterprise:T1059", "Scripts of all kinds", {"objectType": "technique", "techniqueId": "T1059", "techniqueName": "Scripts", "domain": "enterprise"}),
    ("mitre", "mitre:T1059.001", "enterprise:T1059.001", "PowerShell commands", {"objectType": "technique", "techniqueId": "T1059.001", "techniqueName": "PowerShell ", "domain": "enterprise", "parentTechniqueId": "T1059"}),
    ("mitre", "mitre:M1", "enterprise:M1013", "application developer guidance", {"objectType": "mitigation", "id": "M1013", "name": "G", "domain": "enterprise"}),
    ("mitre", "mitre:M2", "mobile:M1013", "application developer guidance", {"objectType": "mitigation", "id": "M1013", "name": "G", "domain": "mobile"}),
    ("sigma", "sigma:1", "s1", "sigma rule T1562 impair defenses", {"title": "a", "ruleId": "r1", "mitreTechniques": ["T1059.001", "T1562"]}),
    ("elastic", "elastic:1", "e1", "T1562.001 tools", {"ruleName": "b", "mitre": [{"techniqueId": "t1059"}]}),
    ("lolbas", "lolbas:1", "l1", "certutil downloads", {"binary": "Certutil.exe", "mitreTechnique": "T1059"}),
    ("ecs", "ecs:1", "process.name", "process.name is the name", {"fieldName": "process.name"}),
]
ASKED = (
    ("a", "T1059.001", "x", "attack_technique", " t1059.001", "T1059.001", ""), ("n", "PowerShell", "x", "technique_name", "powershell", "", ""), ("e", "process.name", "x", "ecs_field", "Process.Name", "", "process.name"), ("l", "certutil", "x", "lolbas_binary", "certutil.exe", "", ""),
    ("u", "T1562 impair defenses", "x", "citing_records_only", "T1562", "T1562", ""), ("m", "M1013", "x", "all_candidates", "M1013", "M1013", ""), ("z", "TA0011", "x", "none_expected", "TA0011", "TA0011", ""),
)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(s, i + 1, ident, sid, text, json.dumps(m)) for i, (s, ident, sid, text, m) in enumerate(RECORDS)]
    records = settled(spark.createDataFrame(rows, "source string, line_number int, id string, source_id string, text string, m string").withColumn("metadata", F.parse_json("m")).drop("m"))
    nodes, edges, _ = G.built(records)
    nodes, edges = settled(nodes.withColumn("attack_id", F.col("properties")["attackId"])), settled(edges)
    chunks = settled(C.chunked(records).withColumn("chunk_ord", F.col("part")))
    return records, nodes, edges, chunks


def test_truth(corpus, spark):
    got = {}
    for r in B.truth(B.cases(spark, ASKED), corpus[0]).collect():
        got.setdefault(r.case_id, {})[r.record_id] = r.grade
    assert got == {
        "a": {"mitre:T1059.001": 3, "sigma:1": 2, "mitre:T1059": 1}, "n": {"mitre:T1059.001": 3, "sigma:1": 1}, "e": {"ecs:1": 3}, "l": {"lolbas:1": 3}, "u": {"sigma:1": 2}, "m": {"mitre:M1": 3, "mitre:M2": 3},
    }
    for row, why in ((("a", "", "x", "attack_technique", "T7", "", ""), "nothing defines"), (("a", "", "x", "technique_name", "T7", "", ""), "called"), (("a", "", "x", "ecs_field", "q", "", ""), "nothing is"), (("a", "", "x", "citing_records_only", "T1059", "", ""), "is defined"), (("a", "", "x", "all_candidates", "T1059", "", ""), "ambiguous"), (("a", "", "x", "odd", "T1059", "", ""), "no rule")):
        with pytest.raises(Exception, match=why):
            B.truth(B.cases(spark, (row,)), corpus[0]).collect()
        assert B.truth(B.cases(spark, (row,)), corpus[0], strict=False).count() >= 0


def test_cases(spark):
    assert len(B.CASES) == len({c[0] for c in B.CASES}) == 36 and {c[3] for c in B.CASES} == set(B.RULES)
    assert B.case_queries(B.cases(spark)).count() == 36


IDS = ("node_id", "canonical_id", "attack_id", "name")


def test_run_report_and_service(corpus, spark, tmp_path):
    records, nodes, edges, chunks = corpus
    asked = B.cases(spark, ASKED)
    judgments = settled(B.truth(asked, records))
    service = R.Service(chunks, nodes, edges, IDS, str(tmp_path / "service"))
    scores, rankings = B.run(asked, judgments, service.chunks, service.nodes, service.edges, IDS, index=service.index)
    scores = settled(scores)
    by = {(r["mode"], r.case_id): r for r in scores.collect()}
    assert len(by) == 21 and by["text", "z"].skipped and not by["text", "a"].skipped and by["hybrid", "a"].mrr == 1.0
    plain = {tuple(r) for r in R.modes(B.case_queries(asked), chunks, nodes, edges, IDS).collect()}
    assert plain == {tuple(r) for r in rankings.collect()}  # a stored index finds what a search of the chunks finds
    made = B.report(scores, rankings, judgments)
    misses = {tuple(r) for r in made["misses"].collect()}
    assert ("graph", "l") in misses  # a case that found nothing is a miss
    payload = sinks.evaluation_payload(made, version="1")
    assert "| graph |" in sinks.evaluation_markdown(payload) and json.loads(sinks.report(payload)[0])["version"] == "1"
    parts = spark.createDataFrame([("full", 0.9), ("lexical", 0.5), ("graph", 0.5), ("source", 0.95)], "variant string, ndcg_10 double")
    assert tuple(B.worst_ablation(parts).first()) == ("graph", 0.5, 0.4)
    report = service.report().first()
    assert report.chunks == report.records == 8 and report.graph_nodes == 8 and dict(map(tuple, report.sources))["mitre"] == 4
    assert [r.chunk_id for r in service.chunks_of(spark.createDataFrame([("ecs:1",)], "record_id string")).collect()] == ["ecs:1:field:001"]
    found = service.for_requirements(spark.createDataFrame([(1, "certutil")], "request_id int, requirement string")).collect()
    assert [r.record_id for r in found] == ["lolbas:1"]
    rules = spark.createDataFrame([("r", "nothing", ["T1059"], [], [])], "rule_id string, text string, entity_ids array<string>, canonical_fields array<string>, lexical_fields array<string>")
    assert service.for_rules(rules).filter("score_exact = 1").first().record_id == "mitre:T1059"
    plan = X.scores(None, spark.createDataFrame([("q", "certutil")], "query_id string, text string"), index=service.index)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 1
    empty = tmp_path / "empty"
    X.save(chunks.limit(0), str(empty))
    assert X.load(spark, str(empty)).chunks == 0 and X.scores(None, B.case_queries(asked).select("query_id", "text"), index=X.load(spark, str(empty))).collect() == []


def test_safety(corpus):
    _, nodes, edges, chunks = corpus
    got = B.safety(chunks, nodes, edges, IDS, F.col("attack_id")).orderBy("ordinal").collect()
    assert len(got) == 16 and [r.check for r in got if not r.passed] == [] and got[0].subject == "T1562"
    bad = nodes.withColumn("node_type", F.when(F.col("node_type") == "mitigation", "tactic").otherwise(F.col("node_type")))
    assert [r.check for r in B.safety(chunks, bad, edges, IDS, F.col("attack_id")).collect() if not r.passed] == ["no_tactic_nodes_fabricated"]


def test_result_views(corpus, spark):
    _, nodes, edges, chunks = corpus
    asked = B.case_queries(B.cases(spark, ASKED))
    results = settled(R.retrieved(asked, chunks, nodes, edges, IDS))
    known = chunks.withColumns({"source_id": F.lit("x"), "location": F.lit("y")})
    assert R.problems(results, known).collect() == []
    assert {r.code for r in R.problems(results.withColumn("evidence", F.filter("evidence", lambda e: e.hops > 9)), known.withColumn("location", F.lit(""))).collect()} == {"no_evidence", "no_method", "incomplete_provenance"}
    kept, removed = R.post_filtered(results, ("mitre",))
    assert {r.source for r in kept.collect()} == {"mitre"} and sum(r.removed for r in removed.collect()) == results.count() - kept.count()
    flat = {(r.query_id, r.chunk_id): r for r in R.flattened(results).collect()}
    one = flat["a", "mitre:T1059.001:description:001"]
    assert one.provenance["methods"] == "graph" and one.provenance["hops"] == "0" and one.score["exact"] == "1.000000"
    reports = spark.createDataFrame([("q", 0, "T1086", "redirected", ["n"], "T1059.001"), ("q", 1, "t1086", "redirected", ["n"], "T1059.001"), ("q", 2, "x", "unresolved", [], None)], "query_id string, ordinal int, value string, status string, node_ids array<string>, successor string")
    assert [tuple(r) for r in R.redirect_groups(reports).collect()] == [("q", "T1059.001", ["T1086", "t1086"])]
    assert E.ablations(results.select(*[c for c in results.columns if c.startswith("score_")])).count() == 6 * results.count()


def test_store_merges(corpus):
    _, nodes, edges, _ = corpus
    assert "MERGE (n:kb {node_id: row.node_id})" in sinks.merge_statement("nodes", "kb") and "namespace = 'kb'" in sinks.merge_statement("edges", "kb")
    with pytest.raises(ValueError, match="no name"):
        sinks.merge_statement("nodes", "a b")
    row = nodes.filter("node_type = 'technique'").select(*sinks.NODE_COLUMNS).first().asDict(recursive=True)
    made = sinks.merge_rows([row], "nodes")[0]
    assert made["node_id"] == row["node_id"] and made["values"]["prov_dataset"] == "mitre.jsonl" and "properties" not in made["values"]
    sinks.merged_into(nodes, edges, lambda: lambda statement, rows: None, "kb", 2)
