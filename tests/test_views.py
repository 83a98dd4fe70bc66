"""Views of entities and of mapped entities, the registry, and whole rules that flow into extraction."""

import pytest
from pyspark.sql import functions as F

from orelode.operators import extraction as X
from orelode.operators import mapping as M
from orelode.operators import rule_parsing as RP
from orelode.session import settled

DOC = '{"title": "t", "level": "high", "author": ["a", "b"], "logsource": {"product": "windows"}, "tags": ["attack.t1059", "attack.t1059", "x"], "detection": {"sel": {"Image|endswith": ["a.exe", "a.exe"], "source": "s", "Hashes": "MD5=0123456789abcdef0123456789abcdef"}, "timeframe": "5m", "condition": "sel"}}'


@pytest.fixture(scope="module")
def found(spark):
    rules = RP.described(spark.createDataFrame([("r", DOC)], "rule_id string, text string"))
    return settled(X.extracted(rules))


def test_rule_text_to_entities(found):
    got = {(r.entity_type, r.value) for r in found.collect()}
    assert {("executable", "a.exe"), ("author", "b"), ("product", "windows"), ("timeframe", "5m"), ("severity", "high"), ("field_modifier", "endswith")} <= got
    assert not any(v == "sel" for _, v in got)  # a condition is no block of the detection


def test_entity_views(found):
    assert X.of_type(found, "author").count() == 2 and {r.section for r in X.of_section(found, "tags").collect()} == {"tags"}
    assert {r.extractor for r in X.by_extractor(found, "process").collect()} == {"process"}
    assert X.values_of(found, "executable").first()["values"] == ["a.exe", "a.exe"]
    assert {r.entity_type: r.n for r in X.grouped(found).collect()}["tag"] == 3


def test_registry():
    r = X.Registry.standard()
    assert list(r.names) == list(X.EXTRACTORS) and r.producing("tag") == ("metadata",) and "file" in r.producing("file_hash")
    assert "field_modifier" in r.by_name("field")
    for f, a in ((r.producing, "nothing"), (r.by_name, "nothing")):
        with pytest.raises(KeyError):
            f(a)
    with pytest.raises(ValueError, match="already"):
        r.register("field", ())


def test_mapped_views(found):
    mapped = settled(M.mapped(found))
    assert M.identifiers_of(mapped, "attack_technique_reference").first().identifiers == ["T1059"]
    assert {r.canonical_type: r.n for r in M.grouped(mapped).collect()}["process_image"] == 2
    assert M.of_status(mapped, "unresolved").count() + M.resolved(mapped).count() == mapped.count()
    assert M.of_type(mapped, "file_hash").count() == 1
    one = M.detailed(mapped).filter("entity_type = 'file_hash'").first()
    assert one.confidence == 1.0 and one.attributes == {"algorithm": "md5"}
    with pytest.raises(Exception, match="several readings"):
        M.unambiguous(mapped).collect()
    assert M.unambiguous(mapped.filter(F.col("value") != "source")).count() > 0
