import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orelode.functions.text import tokens
from orelode.operators import text_index as X
from orelode.operators import text_scan as T
from orelode.plans import text as plans

WORDS = [f"w{i}" for i in range(200)] + ["a.b-c", "a", "b", "x_y", "Ünder-w1", "İx.y", "K.k", "--", "a..b", "1.2.3.4"]


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    texts = [" ".join(WORDS[min(int(rng.expovariate(0.03)), len(WORDS) - 1)] if rng.random() < 0.8 else rng.choice(WORDS) for _ in range(rng.randrange(1, 40))) for _ in range(900)]
    texts[:300] = [texts[0]] * 300  # copies tie
    texts[-2:] = ["", None]
    chunks = spark.createDataFrame([(f"c{k:05d}", t) for k, t in enumerate(texts)], "chunk_id string, text string").repartition(5)
    asked = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(25)] + [texts[0], "unknown", "", None, "w0", "w0 W0"]
    return chunks.cache(), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").cache()


@pytest.mark.parametrize("limit", [1, 10, 2000])
def test_same_as_scoring_everything(made, limit):
    chunks, asked = made
    assert rows(T.search(chunks, asked, limit)) == rows(X.top(X.scores(chunks, asked), limit))


def test_parts_and_many_terms(made, monkeypatch):
    chunks, asked = made
    want = rows(T.search(chunks, asked, 7))
    with monkeypatch.context() as m:
        m.setattr(X, "SENT", 3)
        assert rows(T.search(chunks, asked, 7)) == want
    assert rows(T.search(chunks.repartition(1), asked, 7)) == want


def test_terms_are_those_of_the_index(made):
    chunks, _ = made
    for r in chunks.select(F.lower(F.coalesce("text", F.lit(""))).alias("words"), tokens(F.col("text")).alias("tokens")).collect():
        counts = T.term_counts(r.words)
        assert sorted(counts.elements()) == sorted(r.tokens)


def test_a_task_hands_on_the_best_only(monkeypatch):
    """Of chunks that all tie, in slices of a few rows; a term that all have scores 0 when rounded, and counts."""
    monkeypatch.setattr(T, "AT_ONCE", 8)
    batches = [pa.record_batch({"chunk_id": pa.array(range(k, k + 50)), "length": pa.array([3] * 50), "terms": pa.array([[0, 1]] * 50, pa.list_(pa.int32())), "tfs": pa.array([[1, 1]] * 50, pa.list_(pa.int32()))}) for k in (100, 0, 50)]
    out = pa.Table.from_batches(T.best_batches(iter(batches), ids=pa.array(["p", "q"]), starts=np.array([0, 1, 2]), asking=np.array([0, 1]), idf=np.array([1e-9, 2.0]), average=3.0, limit=4))
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in out.to_pylist()] == [("p", k, 0.0) for k in range(4)] + [("q", k, 2.0) for k in range(4)]


def test_empty(made):
    chunks, asked = made
    assert T.search(chunks.limit(0), asked, 5).collect() == [] and T.search(chunks, asked.limit(0), 5).collect() == []


def test_metrics_build_no_index(spark, monkeypatch):
    """One batch of queries doesn't pay for all postings (F3)."""
    def save(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(X, "save", save)
    monkeypatch.setattr(plans, "_STORED", {})
    assert plans.metric_means(spark, "/root/testdata/sf0.001").count() > 0
