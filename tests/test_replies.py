"""Typed replies: schemas, every check, documents."""

import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import packages as P
from orelode.operators import reply_checks as C
from orelode.operators import reply_specs as S
from orelode.operators.replies import schema_issues
from orelode.session import settled

CITE = {"item_id": "graph:0000", "source": "mitre", "identifier": "T1059", "detail": "d"}
FINDING = {"finding_id": "F1", "category": "logic", "severity": "high", "statement": "s", "explanation": "e", "support": "supported", "evidence": [CITE], "confidence": 0.9}
ADVICE = {"recommendation_id": "R1", "category": "evasion", "priority": "low", "action": "a", "rationale": "r", "addresses": ["F1"], "support": "unsupported", "code_snippet": "a\nb"}
UNSURE = [{"identifier": "T9999", "status": "unresolved", "candidates": [], "treatment": "t"}, {"identifier": "M1013", "status": "ambiguous", "candidates": ["a", "b"], "treatment": "t"}]
MITRE = {"tactic_id": "TA0002", "tactic_name": "", "technique_id": "T1059.001", "technique_name": "Power  SHELL", "confidence": 0.125, "parent_technique_id": "T1059", "parent_technique_name": ""}
RULE = {"title": "t", "description": "d", "rule_type": "eql", "language": "eql", "query": "new query", "severity": "low", "risk_score": 21, "index_patterns": ["i"], "false_positives": [], "tags": ["x"], "investigation_guide": "g", "mitre": [MITRE]}
BASE = {"summary": "sum", "findings": [FINDING], "recommendations": [ADVICE], "confidence": 0.5, "metadata": {"k": "v"}, "uncertainties": UNSURE}
CLAIM = MITRE | {"support": "supported", "evidence": [CITE]}
GOOD = {
    "analyze": BASE | {"operation": "analyze", "score": 86, "fp_risk": "critical", "strengths": ["s"], "weaknesses": ["w"], "evasion_risks": [{"technique": "t", "description": "d", "mitigation": "m"}], "mappings": [CLAIM]},
    "enhance": BASE | {"operation": "enhance", "original_rule": {"identifier": "", "title": "t", "language": "", "query": "old ( query )"}, "enhanced_rule": RULE, "changes": [{"change_id": "C1", "category": "coverage", "before": "old", "after": "new", "rationale": "r", "addresses": ["F1"], "evidence": [CITE], "support": "supported"}]},
    "generate": BASE | {"operation": "generate", "generated_rule": RULE, "rationale": [{"aspect": "metadata", "statement": "s", "rationale": "r", "evidence": []}], "mappings": [CLAIM], "score": 50, "notes": ""},
}


def put(doc, path, value):
    out = json.loads(json.dumps(doc))
    *head, last = path
    at = out
    for p in head:
        at = at[p]
    at[last] = value
    return out


#: Operation, what is broken, and the code that must come of it.
BROKEN = [
    ("analyze", ("operation",), "enhance", "operation_mismatch"), ("analyze", ("score",), 101, "out_of_range"), ("analyze", ("confidence",), 1.5, "out_of_range"), ("analyze", ("summary",), " ", "missing_value"), ("analyze", ("summary",), "a\nb", "several_lines"), ("analyze", ("strengths",), ["s", ""], "missing_value"),
    ("analyze", ("findings",), [FINDING, FINDING], "duplicate"), ("analyze", ("recommendations", 0, "addresses"), ["F2"], "unknown_reference"), ("analyze", ("uncertainties", 0, "candidates"), ["a"], "impossible_combination"), ("analyze", ("uncertainties", 1, "candidates"), [], "impossible_combination"),
    ("analyze", ("findings", 0, "support"), "unsupported", "impossible_combination"), ("analyze", ("findings", 0, "evidence"), [], "unsupported_claim"), ("analyze", ("findings", 0, "evidence", 0, "item_id"), " ", "empty_citation"), ("analyze", ("findings", 0, "evidence", 0, "item_id"), "x:1", "unknown_item"),
    ("analyze", ("findings", 0, "evidence", 0, "identifier"), "T1000", "fabricated_identifier"), ("analyze", ("weaknesses", 0), "as T1234 says", "fabricated_identifier"), ("analyze", ("mappings", 0, "technique_name"), "Power Hell", "fabricated_name"), ("analyze", ("mappings", 0, "parent_technique_id"), "T1", "fabricated_identifier"),
    ("analyze", ("uncertainties",), UNSURE[1:], "uncertainty_dropped"), ("analyze", ("uncertainties", 0), UNSURE[0] | {"status": "ambiguous", "candidates": ["z"]}, "uncertainty_changed"), ("analyze", ("uncertainties", 1, "candidates"), ["a"], "ambiguity_narrowed"), ("analyze", ("uncertainties", 1, "candidates"), ["a", "b", "c"], "fabricated_candidate"),
    ("analyze", ("uncertainties",), [*UNSURE, UNSURE[0] | {"identifier": "T1059"}], "fabricated_uncertainty"), ("analyze", ("findings", 0, "evidence", 0, "identifier"), "M1013", "presented_as_fact"), ("enhance", ("enhanced_rule", "mitre", 0, "tactic_id"), "M1013", "unsettled_in_rule"),
    ("enhance", ("enhanced_rule", "language"), "kql", "language_mismatch"), ("enhance", ("enhanced_rule", "risk_score"), 60, "risk_outside_band"), ("enhance", ("enhanced_rule", "query"), " ", "incomplete_rule"), ("enhance", ("enhanced_rule", "query"), "old (query)", "rule_unchanged"), ("enhance", ("original_rule", "query"), "other", "original_altered"),
    ("enhance", ("changes",), [], "no_changes"), ("enhance", ("enhanced_rule", "mitre", 0, "technique_id"), "T7777", "fabricated_mapping"), ("generate", ("rationale",), [], "no_rationale"), ("generate", ("notes",), 'token = "abcdefgh12"', "credential"), ("generate", ("notes",), "{{RULE}}", "template_mark"), ("generate", ("notes",), "<<RULE>>", "fence_mark"),
    ("generate", ("notes",), "http://no.org/x", "fabricated_reference"), ("analyze", ("findings", 0, "evidence", 0, "source"), "sigma", "source_mismatch"), ("analyze", ("findings", 0, "evidence", 0, "item_id"), "graph:0001", "not_traceable"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"good:{op}", op, json.dumps(doc)) for op, doc in GOOD.items()] + [(f"{i}:{code}", op, json.dumps(put(GOOD[op], path, value))) for i, (op, path, value, code) in enumerate(BROKEN)]
    rows += [("lost", "analyze", json.dumps(put(put(GOOD["analyze"], ("uncertainties",), []), ("findings", 0, "evidence", 0, "item_id"), "knowledge:0000"))), ("none", "analyze", None), ("other", "analyze", json.dumps(GOOD["enhance"] | {"operation": "analyze"}))]
    replies = settled(S.typed(spark.createDataFrame(rows, "request_id string, operation string, reply string")))
    ids = [r[0] for r in rows]
    text = "T1059 and T1059.001 PowerShell: power shell, of TA0002"
    items = [("graph:0000", "retrieved_graph", 1, text, "mitre", "m.jsonl:1", "resolved", {}), ("graph:0001", "retrieved_graph", 2, "more", "mitre", None, "resolved", {}), ("knowledge:0000", "seed_resolution", 3, "T9999", None, None, "unresolved", {"identifier": "T9999", "candidates": ""}), ("knowledge:0001", "seed_resolution", 4, "M1013", None, None, "ambiguous", {"identifier": "M1013", "candidates": "a,b"}), ("knowledge:0002", "seed_resolution", 5, "M1013", None, None, "unresolved", {"identifier": "M1013"})]
    made = spark.createDataFrame([(i, *x) for i in ids for x in items], "package_id string, item_id string, kind string, place int, text string, source string, location string, status string, metadata map<string,string>").withColumns({"source_id": F.lit(""), "record_id": F.lit("")})
    rules = spark.createDataFrame([(i, "raw", "old (query)") for i in ids], "package_id string, raw_text string, query string")
    return replies, settled(C.checked(replies, settled(C.supplied(made, rules))))


def test_good_replies(found):
    replies, issues = found
    assert issues.filter("request_id LIKE 'good%'").collect() == []
    got = {r.request_id: r for r in C.verdicts(replies, issues).collect()}
    assert all(got[f"good:{op}"].valid and got[f"good:{op}"].issues == [] for op in GOOD) and len(got) == replies.count()


def test_every_check(found):
    codes = {}
    for r in found[1].collect():
        codes.setdefault(r.request_id, set()).add(r.code)
    missed = [(i, code, codes.get(f"{i}:{code}")) for i, (_, _, _, code) in enumerate(BROKEN) if code not in codes.get(f"{i}:{code}", ())]
    assert missed == []
    assert {"status_not_preserved", "uncertainty_dropped"} <= codes["lost"] and codes["none"] == {"no_result"} and {"missing_value", "undeclared_field"} <= codes["other"]


def test_verdicts(found):
    replies, issues = found
    got = {r.request_id: r for r in C.verdicts(replies, issues).collect()}
    band = next(r for k, r in got.items() if k.endswith("risk_outside_band"))
    assert band.valid and band.warnings == 1  # a warning alone
    assert [tuple(i) for i in got["lost"].issues] == sorted(tuple(i) for i in got["lost"].issues)
    kept = {r.code for r in C.reasoning_issues(issues).collect()}
    assert "fabricated_identifier" in kept and "credential" not in kept


@pytest.mark.parametrize("operation", S.OPERATIONS)
def test_specs(operation):
    spec = S.SPECS[operation]
    assert list(schema_issues(GOOD[operation], spec)) == []
    empty = S.skeleton(spec)
    assert set(empty) == {f.name for f in spec} and empty["operation"] == operation
    assert S.prompt_text(spec).split("\n")[0] == f"- operation (string; exactly '{operation}')"
    assert S.schema_of(operation)["required"][0] == "operation" and S.schema_of(operation)["additionalProperties"] is False


def test_documents(spark):
    rows = [(op, op, json.dumps(doc), "id", "rule", "q", "m", 7, 8, "u", "now", op == "generate", None, 'a "title"') for op, doc in GOOD.items()]
    replies = S.typed(spark.createDataFrame(rows, "request_id string, operation string, reply string, result_id string, rule_id string, input_query string, model string, tokens int, latency_ms int, user_id string, created_at string, saved boolean, saved_rule_id string, saved_rule_title string"))
    got = {r.request_id: json.loads(r.document) for r in S.documents(replies).collect()}
    one = got["analyze"]["analysis"]
    assert one["rating"] == "A" and one["fpRisk"] == "high" and one["findings"] == [{"category": "logic_error", "severity": "high", "title": "s", "detail": "e"}] and one["outputQuery"] == "" and one["suggestions"][0]["codeSnippet"] == "a\nb"
    assert one["mitreMappings"][0] == {"tacticId": "TA0002", "tacticName": "", "techniqueId": "T1059", "techniqueName": "", "subTechniqueId": "T1059.001", "subTechniqueName": "Power  SHELL", "confidence": 12}
    two = got["enhance"]["analysis"]
    assert two["changelog"] == [{"change": "Changed old to new", "reason": "r"}] and two["score"] == 0 and two["references"] == [] and two["inputQuery"] == "old ( query )" and two["newRiskScore"] == 21
    three = got["generate"]
    assert three["savedRuleId"] is None and three["savedRuleTitle"] == 'a "title"' and three["analysis"]["interval"] == "5m" and three["analysis"]["language"] == "eql" and "ruleId" not in three["analysis"]
    with pytest.raises(Exception, match="can't answer"):
        S.documents(replies.withColumn("operation", F.lit("enhance"))).collect()


def test_supplied_from_packages(spark):
    """The packages' own items are what replies are held against."""
    items = spark.createDataFrame([], P.ITEM).withColumn("place", F.lit(1))
    rules = spark.createDataFrame([("1", "raw", "q")], "package_id string, raw_text string, query string")
    assert C.supplied(items, rules).first().material == "raw\nq"
    accounts = spark.createDataFrame([("1", ["T1", "T1"], ["M1"])], "package_id string, unresolved_identifiers array<string>, ambiguous_identifiers array<string>")
    assert [(e.identifier, e.status) for e in C.supplied(items, rules, accounts).first().ledger] == [("T1", "unresolved"), ("M1", "ambiguous")]


def test_what_was_supplied_is_never_sent_to_all_tasks(spark):
    """20,000 packages whose texts repeat themselves: small as files, yet not to be collected; all groups share one join."""
    replies = settled(S.typed(spark.range(20_000).select(F.col("id").cast("string").alias("request_id"), F.lit("analyze").alias("operation"), F.lit(json.dumps(GOOD["analyze"])).alias("reply"))))
    given = replies.select("request_id", F.repeat(F.lit("T1059 "), 500).alias("material"), F.lit("t1059").alias("folded"), F.create_map(F.lit("graph:0000"), F.struct(F.lit("mitre").alias("source"), F.lit("l").alias("location"), F.lit(True).alias("retrieved"), F.lit("resolved").alias("status"), F.lit("").alias("identifier"))).alias("items"), F.array().cast(C.LEDGER).alias("ledger"), F.lit("").alias("rule_query"))
    plan = C.checked(replies, settled(given))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1
