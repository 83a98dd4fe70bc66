"""Checks of results, ablations, and what a report derives."""

from pyspark.sql import functions as F

from orelode.operators import evaluation as V
from orelode.operators import ranking as R

RESULT = "query_id int, chunk_id string, rank int, total double, evidence array<int>"


def test_result_problems(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.5, [1]), (1, "b", 2, 0.7, []), (1, "gone", 3, 1.2, [1])], RESULT)
    known = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert sorted(map(tuple, R.problems(rows, known).collect())) == [("no_evidence", 1, "b"), ("not_descending", 1, "b"), ("not_descending", 1, "gone"), ("score_range", 1, "gone"), ("unknown_chunk", 1, "gone")]


def test_ablations(spark):
    parts = ("exact", "entity", "graph", "lexical", "source", "distance", "section")
    row = spark.range(1).select(*[F.lit(1.0).alias(f"score_{p}") for p in parts])
    got = {r.variant: r.variant_total for r in V.ablations(row).collect()}
    assert got == {"full": 1.0, "lexical": 0.85, "graph": 0.8, "distance": 0.95, "source": 0.93, "section": 0.97}


def test_best_mode(spark):
    means = spark.createDataFrame([("text", 0.4), ("graph", 0.5), ("hybrid", 0.5)], "mode string, ndcg double")
    got = {r.mode: (r.best, r.delta) for r in V.best_mode(means, "ndcg").collect()}
    assert got == {"text": (False, -0.1), "graph": (True, 0.0), "hybrid": (False, 0.0)}


def test_misses_and_ungrounded_cases(spark):
    ranking = spark.createDataFrame([(1, 1, "a"), (2, 1, "x"), (2, 2, "a")], "case_id int, position int, record_id string")
    judged = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "x", 0)], "case_id int, record_id string, grade int")
    assert [r.case_id for r in V.first_misses(ranking, judged).collect()] == [2]
    cases = spark.createDataFrame([(1, 0, "T1"), (3, 0, "T9")], "case_id int, ordinal int, anchor string")
    assert [r.case_id for r in V.ungrounded(cases, judged).collect()] == [3]


def test_truth_of_a_sub_technique(spark):
    cases = spark.createDataFrame([(1, 0, "t1.001")], "case_id int, ordinal int, anchor string")
    defined = spark.createDataFrame([("T1.001", "own"), ("T1", "parent")], "identifier string, record_id string")
    cited = V.citations(spark.createDataFrame([("t1.001 ", "rule", "sigma"), ("T1.001", "rule", "sigma"), ("T1.001", "own", "mitre")], "value string, record_id string, source string"))
    assert {r.record_id: r.grade for r in V.technique_truth(cases, defined, cited).collect()} == {"own": 3, "rule": 2, "parent": 1}
