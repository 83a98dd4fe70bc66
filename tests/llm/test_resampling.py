import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orelode.llm import queries, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = ["the", "THE", "Cat", "é", "É", "ß9", "-", "_", "\n", "\x00", "\x7f", "0", "😀", "{", "a b", " ", ".", "[", "`", "Ünder"]


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def features_of(text, n=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, targets, percent=25, n=2, buckets=10_000, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, targets)):
        for text in texts:
            for f in features_of(text, n):
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for k, (doc, text) in enumerate(docs):
        own = [gain[bucket(f)] for f in features_of(text, n)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, k])
    enough = sorted((r for r in rows if len(words_of(docs[r[5]][1])) >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def text_of(rng, longest=80):
    return None if rng.random() < 0.05 else rng.choice(["", " "]).join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(longest)))


def test_query_like_a_plain_version(spark, tmp_path):
    rng = random.Random(1)
    docs = [(rng.choice([k, k, k, None]), text_of(rng)) for k in range(200)] + [(900, "word " * 60_000 + "end"), (901, "x" * 300_000), (902, "")]
    docs += docs[:60]  # repeated rows
    targets = [text_of(rng) for _ in range(20)]
    spark.createDataFrame([(d, t, None, None, None) for d, t in docs], SCHEMA).withColumns({"doc": F.lit(1), "Buckets": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(targets)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op11_resampling(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(docs, targets)))


@pytest.mark.parametrize(("documents", "targets"), [(0, 3), (5, 0), (0, 0)])
def test_empty_tables(spark, documents, targets):
    rng = random.Random(2)
    docs, wanted = [(k, text_of(rng)) for k in range(documents)], [text_of(rng) for _ in range(targets)]
    out = resampling.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in wanted], "text string"))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(docs, wanted)))


def test_other_parameters(spark):
    rng = random.Random(3)
    docs, wanted = [(k, text_of(rng)) for k in range(60)], [text_of(rng) for _ in range(9)]
    df = spark.createDataFrame(docs, "id long, body string")
    out = resampling.resampled(df, spark.createDataFrame([(t,) for t in wanted], "body string"), "id", "body", "body", percent=50, n=3, buckets=64, least_words=5, seed=1, piece=40)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain(docs, wanted, 50, 3, 64, 5, 1), key=repr)


@pytest.mark.parametrize(("n", "size", "at_once"), [(1, 7, 1), (2, 1, 50), (2, 30, 30), (3, 5, 1 << 20), (4, 11, 9)])
def test_pieces_lose_no_run(n, size, at_once):
    """Whatever the pieces and portions, each text has all its features once."""
    rng = random.Random(n * size)
    texts = [text_of(rng, 60) for _ in range(12)] + ["nobreak" * 30, "a", None, "A-b " * 40]
    batch = pa.record_batch({"doc": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    *rows, counts = resampling.spill(iter([batch]), n, 1000, size, at_once)
    found = [(w, sorted(b)) for r in rows for w, b in zip(r.column("n_words").to_pylist(), r.column("buckets").to_pylist(), strict=True)]
    want = [(len(words_of(t)), sorted(zlib.crc32(f.encode()) % 1000 for f in features_of(t, n))) for t in texts]
    assert found == want
    total = {}
    for _, own in want:
        for b in own:
            total[b] = total.get(b, 0) + 1
    assert {c["bucket"]: c["n"] for c in counts.column("counts")[0].as_py()} == total


def test_floors_go_down(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (-6, 2), (0, 3), (5, 0), (-1, 10**12), (2**62, 3)], "a long, b long")
    assert [r[0] for r in df.select(resampling.floored(F.col("a"), F.col("b"))).collect()] == [-4, 3, -3, 0, 0, -1, 2**62 // 3]
