"""Corpus lines, envelopes, references and their resolution."""

import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import references as R
from orelode.sources import corpus as S


def line(ident, source_id="s", text="t", **metadata):
    return json.dumps({"id": ident, "sourceId": source_id, "text": text, "metadata": metadata})


@pytest.fixture
def root(tmp_path):
    files = {
        "mitre": [line("m1", "a", objectType="technique", techniqueId="T1059", techniqueName="Scripts", url="u", tactics=["TA0002", 7]), "", "  ", line("m2", "a", techniqueId="t1059.001", name="Shell", parentTechniqueId="T1059"), line("m3", "b", techniqueId="T9999"), line("m4", "c", techniqueId="T9999"), line("m1", "again")],
        "sigma": [line("s1", "x", title="R", ruleId="r1", mitreTechniques=["t1059", "T4040", "T9999"], tags=["attack.t1059.001", "attack.execution", "other"])],
        "elastic": [line("e1", "y", ruleName="E", mitre=[{"tacticId": "TA0002", "techniqueId": "T1059"}])],
        "lolbas": [line("l1", "z", binary="x.exe", mitreTechnique="T1059")],
    }
    for source, rows in files.items():
        (tmp_path / source).mkdir()
        (tmp_path / source / f"{source}.jsonl").write_text("\n".join(rows) + "\n")
    return str(tmp_path)


def test_lines_count_blank_ones(spark, root):
    rows = S.corpus(spark, root)
    got = {(r.source, r.line_number): r.id for r in rows.collect()}
    assert got["mitre", 1] == "m1" and got["mitre", 4] == "m2" and got["mitre", 7] == "m1"
    assert S.available(spark, root) == (["mitre", "sigma", "elastic", "lolbas"], ["ecs"])
    first = {r.id: r.source_id for r in S.first_records(rows).collect()}
    assert first["m1"] == "a"
    assert {r.source: (r.records, r.ids, r.repeated) for r in S.counts(rows).collect()}["mitre"] == (5, 4, 1)
    assert len(S.digests(spark, root)) == 4


@pytest.mark.parametrize(("bad", "why"), [("{", "not valid JSON"), ("[1]", "not a JSON object"), ('{"id": "a"}', "missing key sourceId"), ('{"id": 1, "sourceId": "s", "text": "t", "metadata": {}}', "id must be a string"), ('{"id": "a", "sourceId": "s", "text": "t", "metadata": []}', "metadata must be an object")])
def test_broken_lines(spark, bad, why):
    rows = spark.createDataFrame([("mitre", 3, bad), ("mitre", 4, line("ok"))], "source string, line_number int, line string")
    assert [r.fault for r in S.parsed(rows, strict=False).orderBy("line_number").collect()] == [why, None]
    with pytest.raises(Exception, match=f"mitre line 3: {why}"):
        S.parsed(rows).collect()


def test_references_and_resolution(spark, root):
    rows = S.first_records(S.corpus(spark, root))
    made = R.normalized(rows)
    got = {r.id: r for r in made.collect()}
    assert got["m1"].title == "Scripts" and list(got["m1"].identifiers) == ["T1059", "a", "m1"] and list(got["m2"].unknown_fields) == ["url", "object_type"]
    refs = R.references(rows)
    listed = {(r.id, r.ordinal): (r.field, r.value, r.kind) for r in refs.collect()}
    assert listed["m1", 0] == ("tactics", "TA0002", "tactic") and listed["m2", 0] == ("parentTechniqueId", "T1059", "technique")
    assert [listed["s1", i][1] for i in range(4)] == ["T1059", "T4040", "T9999", "T1059.001"]
    assert ("s1", 4) not in listed
    index = R.identifier_index(made.withColumn("ordinal", F.col("line_number")), keep=("id", "ordinal"))
    out = R.resolved(refs.withColumn("ref", F.concat_ws("|", "id", "ordinal")), index)
    status = {(r.id, r.value): (r.status, list(r.candidates)) for r in R.listed(out, R.candidate_sets(index, out)).collect()}
    assert status["s1", "T1059"] == ("resolved", ["m1"])
    assert status["s1", "T9999"] == ("ambiguous", ["m3", "m4"])
    assert status["s1", "T4040"] == ("unresolved", [])
    assert status["s1", "T1059.001"] == ("resolved", ["m2"])
    assert {r.status: r.n for r in R.resolution_counts(out).collect()}["ambiguous"] == 1


def test_an_identifier_twice_is_ambiguous(spark):
    index = R.identifier_index(spark.createDataFrame([("a", 1, ["x", "X "])], "id string, ordinal int, identifiers array<string>"), keep=("id", "ordinal"))
    refs = spark.createDataFrame([("r", "X")], "ref string, value string")
    assert R.resolved(refs, index).first().status == "ambiguous"


def test_a_hot_key_costs_a_sum(spark):
    """300,000 references to one key of 2,000 records: the join has a row for each key, the set is there once."""
    index = spark.range(2000).selectExpr("'HOT' AS key", "concat('r', id) AS id", "id AS ordinal").unionByName(spark.createDataFrame([("ONE", "x", 1)], "key string, id string, ordinal long"))
    refs = spark.range(300_000).selectExpr("id AS ref", "CASE id % 3 WHEN 0 THEN ' hot' WHEN 1 THEN 'Hot ' ELSE 'one' END AS value")
    out = R.resolved(refs, index)
    got = {(r.status, r.n_candidates, r.record, r.candidate_set): r["n"] for r in out.groupBy("status", "n_candidates", "record", "candidate_set").agg(F.count("*").alias("n")).collect()}
    assert got == {("ambiguous", 2000, None, "HOT"): 200_000, ("resolved", 1, "x", "ONE"): 100_000}
    sets = R.candidate_sets(index, out.filter("status = 'ambiguous'")).collect()
    assert [(r.place, r.record) for r in sorted(sets, key=lambda r: r.place)] == [(k, f"r{k}") for k in range(2000)]


def test_merged_sets_match_plain_lists(spark, monkeypatch):
    """Sets sent to all tasks, groups of more references than are looked up side by side, and shuffled sets give the same rows."""
    index = spark.range(60).selectExpr("concat('K', CAST(id % 7 AS STRING)) AS key", "concat('r', CAST(id AS STRING)) AS id", "id DIV 2 AS ordinal")
    refs = spark.range(400).selectExpr("CASE WHEN id < 12 THEN 0 ELSE id DIV 3 END AS ref", "concat(' k', CAST(id * 5 % 9 AS STRING)) AS value")
    by_key, by_ref = {}, {}
    for k in range(60):
        by_key.setdefault(f"k{k % 7}", []).append((k // 2, f"r{k}"))
    rows = [(r.ref, r.value) for r in refs.collect()]
    for ref, value in rows:
        by_ref.setdefault(ref, []).extend(by_key.get(value.strip(), []))
    want = sorted((ref, value, len(by_ref[ref]), ",".join(r for _, r in sorted(by_ref[ref]))) for ref, value in rows)
    for sent in (R.SENT, 10):
        monkeypatch.setattr(R, "SENT", sent)
        out = R.merged_sets(R.keyed(refs, "value", None), R.sets_of(index, "ordinal", "id", None), "ref")
        assert sorted(tuple(r) for r in out.select("ref", "value", "n_candidates", "candidates").collect()) == want


def test_references_to_a_hot_key_shuffle_no_candidates(spark):
    """20,000 references to a key of 500 records: 10 million candidates, of which none meets a row of its own."""
    index = spark.range(500).selectExpr("'HOT' AS key", "concat('r', id) AS id", "id AS ordinal")
    refs = R.keyed(spark.range(20_000).selectExpr("id DIV 2 AS ref", "'hot' AS value"), "value", None)
    out = R.merged_sets(refs, R.sets_of(index, "ordinal", "id", None), "ref").withColumn("size", F.length("candidates"))
    assert out.agg(F.sum("n_candidates"), F.min("size"), F.max("size")).first() == (20_000_000, 4779, 4779)
    status, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    last = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    recent = [last.apply(i) for i in range(min(15, last.size()))]
    assert max(s.shuffleWriteRecords() for s in recent) <= 20_000


def test_references_are_read_once_and_answers_lie_together(spark, tmp_path):
    """Groups without a set, of few and of many references come from one shuffle; each task writes a set's text in one stretch."""
    read, folder = spark.sparkContext.accumulator(0), str(tmp_path / "out")

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    index = spark.range(900).selectExpr("concat('K', CAST(id % 30 AS STRING)) AS key", "concat('r', CAST(id AS STRING)) AS id", "id AS ordinal")
    refs = spark.range(6000).selectExpr("CASE WHEN id < 40 THEN -1 ELSE id END AS ref", "concat('k', CAST(id * 7 % 40 AS STRING)) AS value").mapInArrow(counted, "ref long, value string")
    R.merged_sets(R.keyed(refs, "value", None), R.sets_of(index, "ordinal", "id", None), "ref").write.parquet(folder)
    assert read.value == 6000
    rows = spark.read.parquet(folder).filter("ref >= 0 AND candidates <> ''").selectExpr("input_file_name() AS file", "monotonically_increasing_id() AS at", "candidates").orderBy("at").collect()
    assert len(rows) == 4470
    stretches = sum(i == 0 or (a.file, a.candidates) != (rows[i - 1].file, rows[i - 1].candidates) for i, a in enumerate(rows))
    assert stretches <= 30 + len({r.file for r in rows})
