"""Packages from all their inputs, and what breaks them."""

import pytest
from pyspark.sql import functions as F

from orelode.operators import context as C
from orelode.operators import extraction as X
from orelode.operators import mapping as M
from orelode.operators import packages as P
from orelode.operators import retrieval as R
from orelode.operators import rule_parsing as RP
from orelode.session import settled

DOC = '{"title": "A rule", "id": "r-1", "logsource": {"category": "c", "product": "p"}, "detection": {"sel": {"Image": "a.exe", "user": " "}, "condition": "sel"}, "tags": ["attack.t1086", "odd"], "references": ["http://x", "http://y"], "falsepositives": ["none", "few"], "description": "password: hunter2hunter2"}'


@pytest.fixture(scope="module")
def parts(spark):
    rules = settled(RP.described(spark.createDataFrame([("1", DOC), ("2", '{"name": "bare", "type": "eql"}')], "rule_id string, text string")))
    chunks = spark.createDataFrame([("m1:d:001", "m1", "mitre", "description", "T1059.001 shell, token=abcdefgh1234", 0, "sid1", "mitre.jsonl:1"), ("m1:d:002", "m1", "mitre", "description", "more of it", 1, "sid1", "mitre.jsonl:1"), ("s1:q:001", "s1", "sigma", "query", "a.exe rule", 0, "sid2", "sigma.jsonl:4")], "chunk_id string, record_id string, source string, section string, text string, chunk_ord int, source_id string, location string")
    nodes = spark.createDataFrame([("t", "m1", "T1059.001", "Shell"), ("s", "s1", "rule-1", "A.exe rule")], "node_id string, record_id string, canonical_id string, name string")
    edges = spark.createDataFrame([("s-t", "detects", "s", "t")], "key string, type string, start_id string, end_id string")
    queries = spark.createDataFrame([("1", "a.exe", ["T1086", "T9999"], [], [], [], []), ("2", "zzz", [], [], [], [], [])], "query_id string, text string, entity_ids array<string>, canonical_fields array<string>, lexical_fields array<string>, sources array<string>, sections array<string>")
    ids = ("node_id", "canonical_id", "name")
    results = settled(R.retrieved(queries, chunks, nodes, edges, ids))
    reports = R.graph_route(queries, chunks, nodes, edges, ids)[1]
    return rules, chunks, nodes, results, reports


@pytest.fixture(scope="module")
def package(spark, parts):
    rules, chunks, nodes, results, reports = parts
    context = P.rule_context(rules)
    entities = settled(X.extracted(rules).withColumn("package_id", F.col("rule_id")))
    mapped = settled(M.mapped(entities))
    P.refuse_secrets(context, entities, mapped)
    batches = [P.rule_batch(context), P.entity_batch(entities), P.mapping_batch(mapped), P.retrieval_batch(results, chunks, spark.createDataFrame([("1",), ("2",)], "package_id string")), P.seed_batch(reports, P.successor_records(reports, nodes, chunks)), P.reference_batch(context)]
    items, warnings = P.gathered(batches)
    operations = spark.createDataFrame([("1", "analyze"), ("2", "enhance")], "package_id string, operation string")
    retrievals = spark.createDataFrame([("1", "hybrid", 3, 3)], "package_id string, mode string, items int, candidates int")
    final, told = P.built(items, warnings, operations, retrievals)
    return items, final.cache(), told.cache(), operations, entities, mapped


def test_rule_text(package):
    rows = {r.item_id: r.text for r in package[1].filter("package_id = '1' AND section = 'rule'").collect()}
    assert rows == {"rule:0000": "Title: A rule\nIdentifier: r-1\nFormat: sigma\nLanguage: sigma\nLog source: category=c, product=p\nTags: attack.t1086, odd\nFalse positives: none; few", "rule:0001": "Condition: sel"}
    two = {r.item_id: r.text for r in package[1].filter("package_id = '2' AND section = 'rule'").collect()}
    assert two["rule:0001"] == '{"name": "bare", "type": "eql"}'  # neither query nor condition


def test_items_and_warnings(package):
    final, told = package[1], package[2]
    one = final.filter("package_id = '1'").orderBy("place").collect()
    sections = list(dict.fromkeys(r.section for r in one))
    assert sections == [s for s in C.SECTIONS if s in sections] and {"entities", "mappings", "graph", "knowledge", "references", "warnings", "metadata"} <= set(sections)
    text = {r.item_id: r.text for r in one}
    assert text["knowledge:0000"] == "identifier T1086 -> T1059.001: redirected (candidates: t)" and text["knowledge:0001"].endswith("unresolved (candidates: none)")
    assert text["knowledge:0000:successor"] == "T1059.001 shell, token=[REDACTED]\n\nmore of it"
    assert text["references:0001"] == "http://y" and not any("abcdefgh1234" in t for t in text.values())
    codes = [(r.code, r.item_id) for r in told.filter("package_id = '1'").orderBy("batch", "ordinal").collect()]
    assert ("redirected_reference", "knowledge:0000") in codes and ("unresolved_reference", "knowledge:0001") in codes and ("credential_redacted", "knowledge:0000:successor") in codes
    assert any(c == "unresolved_reference" and i.startswith("mappings:") for c, i in codes)
    assert [r.code for r in told.filter("package_id = '2'").collect()].count("empty_retrieval") == 1
    last = one[-1].text.split("\n")
    assert last[0] == "operation=analyze" and last[-1] == "retrieval_mode=hybrid items=3 candidates=3" and any(x.startswith("section=warnings items=") for x in last)


def test_whole_packages_have_no_problems(package):
    assert [tuple(r) for r in P.problems(package[1]).collect()] == []


def test_broken_packages(package, spark):
    final = package[1].filter("package_id = '1'")
    bad = final.withColumns({
        "status": F.when(F.col("item_id") == "knowledge:0000", "resolved").otherwise(F.col("status")), "location": F.when(F.col("kind") == "retrieved_graph", "").otherwise(F.col("location")),
        "text": F.when(F.col("item_id") == "references:0000", "password: hunter2hunter2").otherwise(F.col("text")), "original_length": F.when(F.col("item_id") == "references:0001", 99).otherwise(F.col("original_length")),
        "metadata": F.when(F.col("item_id") == "knowledge:0001", F.create_map(F.lit("status"), F.lit("ambiguous"), F.lit("candidate_count"), F.lit("2"))).otherwise(F.col("metadata")), "place": F.when(F.col("item_id") == "metadata:0000", 0).otherwise(F.col("place")),
    })
    got = {r.code for r in P.problems(bad).collect()}
    assert got == {"redirected_called_otherwise", "missing_provenance", "credential", "silent_cut", "ambiguous_called_otherwise", "ambiguous_candidates_lost", "section_order"}


def test_small_budget_and_provenance(package, parts, spark):
    items, _, _, operations, entities, mapped = package
    final, told = P.built(items, spark.createDataFrame([], P.WARNING), operations, total_limit=120, section_limit=60)
    assert final.filter("section NOT IN ('warnings', 'metadata')").groupBy("package_id").agg(F.sum(F.length("text")).alias("n")).filter("n > 120").count() == 0
    assert {"item_dropped", "item_truncated"} <= {r.code for r in told.collect()}
    with pytest.raises(Exception, match="more than the"):
        P.built(items, spark.createDataFrame([], P.WARNING), operations, total_limit=120, policy="none")[0].collect()
    got = {r.package_id: r for r in P.provenance(operations, parts[3], parts[4], entities, mapped).collect()}
    assert got["1"].unresolved_identifiers == ["T9999"] and got["1"].redirected_identifiers == ["T1086=T1059.001"] and got["1"].entity_count > 3 and got["2"].retrieval_items == 0
    with pytest.raises(ValueError, match="credential"):
        P.refuse_secrets(spark.createDataFrame([], "a struct<reveal:string,_value:string>"))


def test_warning_ceiling(spark):
    """300 warnings of 100 characters: 198 of them and one notice with the number of the others."""
    rows = spark.createDataFrame([(1, i, "x" * 100) for i in range(300)] + [(2, 0, "y")], "package_id int, ordinal int, text string")
    got = C.within_ceiling(rows).orderBy("package_id", "ordinal").collect()
    one = [r for r in got if r.package_id == 1]
    assert len(one) == 200 and one[-1].text.startswith("101 more") and sum(len(r.text) for r in one) <= 20_000
    assert [r.text for r in got if r.package_id == 2] == ["y"]


@pytest.mark.parametrize("deal", [1, 3])
def test_items_of_one_place_are_taken_in_a_stated_order(spark, deal):
    """Two items share a place: whichever comes first decides which of them follows a later section."""
    rows = [("p", "z", "rule", 5, 1), ("p", "a", "graph", 5, 2), ("p", "m", "rule", 6, 3)]
    items = spark.createDataFrame(rows[::-1] if deal == 3 else rows, "package_id string, item_id string, section string, place int, first int").selectExpr("*", "'t' AS text", "false AS truncated").repartition(deal)
    found = lambda order: [(r.code, r.subject) for r in C.problems(items, order=order).collect()]
    assert found(("place", "first")) == [("section_order", "m")] and found(("place", "item_id")) == [("section_order", "z")] == found(("place", "item_id"))


def test_a_rules_fault_is_not_sought_in_a_scan(spark):
    """A filter on faults inside the parsing would parse a document anew for each field, in as few tasks as a scan has."""
    rows = spark.createDataFrame([("a", '{"title": "t", "detection": {"condition": "c"}}'), ("b", "{broken")], "rule_id string, text string")
    context = P.rule_context(RP.described(rows))
    assert [r.package_id for r in context.collect()] == ["a"]
    assert "parse_json" not in context._jdf.queryExecution().optimizedPlan().toString()


def test_parsing_is_dealt_over_all_cores(spark):
    """Tables of one file and few rows a core would be parsed by one task."""
    from orelode.plans import builds, packs

    cores, sf = spark.sparkContext.defaultParallelism, "/root/testdata/sf0.001"
    assert packs.replies(spark, sf).rdd.getNumPartitions() == cores
    assert builds.records(spark, sf).rdd.getNumPartitions() == cores * len(builds.TABLES)
