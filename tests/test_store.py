import pytest
from pyspark.sql import functions as F

from orelode.operators import extraction as X
from orelode.sources import corpus as S
from orelode.sources import store

SCHEMA = "id string, v long, m map<string,string>"


def rows(spark, *given):
    return spark.createDataFrame([(i, v, {"b": str(v), "a": "x"}) for i, v in given], SCHEMA)


def held(spark, path, version=None):
    return {r.id: r.v for r in store.read(spark, path, rows(spark).schema, version).collect()}


def test_merges_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert held(spark, path) == {} and store.versions(spark, path) == []
    first = store.merge(rows(spark, *[(f"k{i}", i) for i in range(200)]), path, "id", buckets=16)
    assert first == {"came": 200, "added": 200, "changed": 0, "written": 200, "version": 1}
    second = store.merge(rows(spark, ("k7", 70), ("new", 1), ("k8", 8), ("k7", 71)), path, "id", ["v"])
    assert (second["came"], second["added"], second["changed"], second["version"]) == (3, 1, 1, 2)
    assert 2 <= second["written"] < 60  # two buckets of sixteen
    want = {f"k{i}": i for i in range(200)} | {"k7": 71, "new": 1}
    assert held(spark, path) == want
    assert held(spark, path, 1) == {f"k{i}": i for i in range(200)}
    again = store.merge(rows(spark, ("k7", 71), ("new", 1)), path, "id")
    assert (again["written"], again["version"]) == (0, 2) and store.versions(spark, path) == [1, 2]
    assert store.vacuumed(spark, path) == 0 or held(spark, path) == want
    assert held(spark, path) == want and store.versions(spark, path) == [2]


def test_a_failed_merge_leaves_the_version(spark, tmp_path):
    path = str(tmp_path / "t")
    store.merge(rows(spark, ("a", 1), ("b", 2)), path, "id")
    broken = rows(spark, ("a", 5)).withColumn("v", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken, path, "id")
    with pytest.raises(Exception, match="without a key"):
        store.merge(rows(spark, (None, 5)), path, "id")
    assert held(spark, path) == {"a": 1, "b": 2}
    (tmp_path / "t" / "versions" / "2").mkdir()  # a merge that has begun to write its manifest
    assert held(spark, path) == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="exists"):
        store.merge(rows(spark, ("a", 6)), path, "id")
    assert held(spark, path) == {"a": 1, "b": 2}


def test_tree_digests(spark, tmp_path):
    file = tmp_path / "f.jsonl"
    lines = [f"line {i} é".encode() for i in range(3000)] + [b"\xff\xfe", b"", b"x\r"]

    def digest(content, **conf):
        file.write_bytes(content)
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            return S.file_digest(spark, str(file), leaf=16, fanout=4)
        finally:
            for k in conf:
                spark.conf.unset(k)

    whole = b"\n".join(lines) + b"\n"
    one = digest(whole)
    assert digest(whole, **{"spark.sql.files.maxPartitionBytes": "1000"}) == one == digest(whole, **{"spark.sql.files.maxPartitionBytes": "777"})
    changed = [whole[:-1], whole + b"\n", whole.replace(b"\xff", b"\xfd"), whole.replace(b"line 7 ", b"line 8 ", 1), b"\n".join([lines[1], lines[0], *lines[2:]]) + b"\n", whole.replace(b"\r", b"")]
    assert len({one, *map(digest, changed), digest(b"")}) == len(changed) + 2


def test_own_extractors(spark):
    rules = spark.createDataFrame([("r1", '{"a": {"Image": "x.exe"}}', "Image:y.exe", ["me"]), ("r2", "{}", "ticket=ABC-12", None)], "rule_id string, detection string, query string, authors array<string>")
    registry = X.Registry.standard()
    plain = X.extracted(rules).collect()
    seen = []

    def tickets(rules, found):
        seen.append(1)
        hits = F.regexp_extract_all("query", F.lit("[A-Z]+-[0-9]+"), F.lit(0))
        return rules.select("rule_id", F.posexplode(hits).alias("n", "value")).withColumns({"entity_type": F.lit("ticket"), "source_field": F.lit("query"), "location": F.lit("query"), "section": F.lit("detection")})

    registry.register("tickets", ("ticket",), tickets)
    out = X.extracted(rules, registry=registry).collect()
    assert [r.value for r in out if r.extractor == "tickets"] == ["ABC-12"] and len(out) == len(plain) + 1
    assert max(out, key=lambda r: r.ordinal).extractor == "tickets"
    assert {r.entity_type for r in X.extracted(rules, ("ticket",), registry).collect()} == {"ticket"}
    seen.clear()
    assert {r.entity_type for r in X.extracted(rules, ("author",), registry).collect()} == {"author"} and not seen
    assert X.extracted(rules, ("nothing",), registry).count() == 0
    assert registry.producing("ticket") == ("tickets",)
    with pytest.raises(ValueError):
        registry.register("tickets", ("ticket",), tickets)
    with pytest.raises(ValueError):
        registry.register("unknown", ("ticket",))
