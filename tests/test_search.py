import random

import pytest
from pyspark.sql import functions as F

from orelode.operators import block_search as S
from orelode.operators import text_index as X

WORDS = [f"w{i}" for i in range(300)]


def corpus(spark, rng, n):
    def text():
        return " ".join(WORDS[min(int(rng.expovariate(0.03)), 299)] for _ in range(rng.randrange(1, 40)))

    texts = [text() for _ in range(n)]
    texts[: n // 3] = [texts[0]] * (n // 3)  # copies tie
    texts[-2:] = ["", "rare-word alone"]
    return spark.createDataFrame([(f"c{k:05d}", t, "s") for k, t in enumerate(texts)], "chunk_id string, text string, source string"), texts


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(7)
    chunks, texts = corpus(spark, rng, 1500)
    path = str(tmp_path_factory.mktemp("index"))
    X.save(chunks, path, buckets=3, slots=2)
    asked = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(25)] + [texts[0], texts[40], "rare-word", "unknown", "", "w0"]
    return chunks.cache(), X.load(spark, path), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string").cache()


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 10, 2000])
def test_same_as_scoring_everything(stored, limit):
    chunks, index, asked = stored
    assert rows(S.search(index, asked, limit)) == rows(X.top(X.scores(chunks, asked), limit))


def test_filters(stored):
    chunks, index, asked = stored
    some = chunks.filter("substring(chunk_id, 6, 1) = '3'").select("chunk_id")
    assert rows(S.search(index, asked, 5, lambda pairs: pairs.join(some, "chunk_id", "left_semi"))) == rows(X.top(X.scores(chunks, asked), 5, some))


def test_matched_terms(stored):
    chunks, index, asked = stored
    found = S.search(index, asked, 3)
    want = X.with_matched(found.drop("matched"), chunks, asked)
    assert {(r.query_id, r.chunk_id): r.matched for r in found.collect()} == {(r.query_id, r.chunk_id): r.matched for r in want.collect()}


def test_blocks_are_skipped(stored):
    _, index, asked = stored
    told = S.report(index, asked, 1).collect()
    assert sum(r.postings_skipped for r in told) > sum(r.postings_read for r in told) / 4
    whole = {r.query_id: r.n for r in X.query_terms(asked).join(index.postings, "term").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert {r.query_id: r.postings_read + r.postings_skipped for r in told} == whole
    assert all(r.blocks_read > 0 for r in told)


def test_no_chunks(spark, stored, tmp_path):
    chunks, _, asked = stored
    X.save(chunks.limit(0), str(tmp_path))
    index = X.load(spark, str(tmp_path))
    assert S.search(index, asked, 5).collect() == [] and X.index_report(index).first().chunks == 0


def test_bounds_hold(stored):
    """No posting of a block is over its impact, and blocks go down."""
    _, index, _ = stored
    own = X.impact(F.col("tf"), F.col("length"), index.average)
    assert index.postings.join(index.blocks, ["bucket", "term", "block"]).filter(own > F.col("impact")).isEmpty()
    highest = {}
    for r in index.blocks.orderBy("term", "block").collect():
        assert r.impact <= highest.get(r.term, 9)
        highest[r.term] = r.impact


def test_few_pairs_are_sent_to_the_chunks(spark, tmp_path):
    """What is scored in full at last is few pairs: chunks' terms, the whole corpus at worst, stay where they are."""
    docs = spark.range(300).selectExpr("id AS chunk_id", "concat('word', CAST(id % 7 AS STRING), ' common ', CAST(id AS STRING)) AS text")
    X.save(docs, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "word3 common")], "query_id long, text string")
    found = S.search(X.load(spark, str(tmp_path / "index")), asked, 5)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [3, 10, 17, 24, 31]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=broadcast)" in plan
