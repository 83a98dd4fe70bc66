import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orelode.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """The root, and each leaf's siblings level by level as (before, after)."""
    steps, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = at - at % fanout
            steps[i].append((level[run:at], level[at + 1 : run + fanout]))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        of = [at // fanout for at in of]
    return level[0], steps


def plain_leaf(row, more=0):
    values = (row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        found[g] = own, *plain_tree([plain_leaf(r) for r in own], fanout)
    root, upper = plain_tree([found[g][1] for g in order], fanout)
    out = []
    for g, above in zip(order, upper, strict=True):
        for r, below in zip(found[g][0], found[g][2], strict=True):
            steps = below + above
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = plain_leaf(r, int(hit))
            for before, after in steps:
                node = sha("".join([*before, node, *after]))
            out.append((r["doc_id"], plain_leaf(r), found[g][1], root, sha("".join(x for a, b in steps for x in [*a, *b])), node, node == root))
    return out


def docs_of(rng, n):
    texts = ["", None, "a:b", "-", "é" * 40, "x" * 100_000]
    return [{"doc_id": rng.choice([None, *range(n)]) if rng.random() < 0.2 else k, "text": rng.choice(texts), "lang": rng.choice(["en", "en", "en", "de", None, "", "ü", "="]), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, 5, -1])} for k in range(n)]


def written_rows(spark, rows, folder):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("n", [1, 2, 700])
def test_query_like_a_plain_tree(spark, tmp_path, n):
    rows = docs_of(random.Random(n), n)
    rows += rows[: n // 3]  # repeated rows
    out = queries.op12_merkle(spark, written_rows(spark, rows, tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(rows)))


def test_empty_table(spark, tmp_path):
    assert queries.op12_merkle(spark, written_rows(spark, [], tmp_path)).count() == 0


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 9), (3, 2, 81), (3, 2, 82), (4, 1, 30), (2, 3, 8), (2, 3, 16), (2, 3, 17), (5, 2, 1)])
def test_buckets_of_any_size(spark, fanout, levels, n):
    """Fanouts and levels of a bucket decide nothing but the work: the tree is that of all leaves."""
    rows = docs_of(random.Random(n), n)
    for k, r in enumerate(rows):
        r.update(doc_id=k, lang="one" if k % 4 else "two")
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).withColumns({"Root": F.lit(1), "AT": F.lit("x"), "node": F.lit(2)})
    out = merkle.manifest(df, "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], "lang", fanout=fanout, levels=levels)
    out = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("left"), F.col("right"))).collect()
    want = {r[0]: r for r in plain(rows, fanout)}
    assert len(out) == n
    for r in out:
        assert (r["leaf"], r["subroot"], r["root"]) == want[r["doc_id"]][1:4] and r["again"] == r["root"]


def test_a_changed_value_changes_the_root(spark):
    fields = ["doc_id", "text"]
    root = lambda rows: merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", fields, "lang").first().root
    same = [(k, "t", "en") for k in range(5)]
    assert len({root(same), root([*same[:4], (4, "T", "en")]), root(same[:4]), root([(1, "1t", "en"), *same[2:]])}) == 4
    with pytest.raises(ValueError):
        merkle.climbed(spark.createDataFrame([], "tree string, at long, node binary"), fanout=1)
