"""Line numbers over stretches of a file, lookups, changed corpora, settings."""

import json
import random
from enum import Enum

import pytest

from orelode import config
from orelode.sources import corpus as S


def test_line_numbers_over_stretches(spark, tmp_path):
    rng = random.Random(3)
    texts = [rng.choice(["", "  ", "\t", json.dumps({"i": i, "pad": "x" * rng.randrange(200)})]) for i in range(3000)]
    f = tmp_path / "a.jsonl"
    f.write_bytes("".join(t + rng.choice(["\n", "\r\n"]) for t in texts).encode() + b"last")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("7k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            rows = S.lines(spark, str(f), "x")
            assert rows.rdd.getNumPartitions() > (1 if size == "7k" else 0)
            assert {r.line_number: r.line for r in rows.collect()} == {i + 1: t for i, t in enumerate([*texts, "last"]) if t.strip()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lookups(spark):
    rows = spark.createDataFrame([("sigma", 3, "b", "s1"), ("mitre", 1, "a", "s1"), ("sigma", 1, "c", "s1"), ("sigma", 2, "b", "s2"), ("sigma", 5, "c", "s3")], "source string, line_number int, id string, source_id string")
    assert [(r.source, r.line_number) for r in S.ordered(rows).collect()] == [("mitre", 1), ("sigma", 1), ("sigma", 2), ("sigma", 3), ("sigma", 5)]
    got = S.by_source_id(rows, spark.createDataFrame([("s1",)], "source_id string")).collect()
    assert sorted((r.source, r.nth, r.id) for r in got) == [("mitre", 1, "a"), ("sigma", 1, "c"), ("sigma", 2, "b")]
    assert [tuple(r) for r in S.repeated_ids(rows).orderBy("ordinal").collect()] == [("sigma", 1, "c", 2), ("sigma", 2, "b", 2)]
    assert [r.line_number for r in S.by_id(rows, spark.createDataFrame([("b",), ("b",)], "id string")).collect()] == [2]


def test_changed_corpus(spark, tmp_path):
    (tmp_path / "ecs").mkdir()
    f = tmp_path / "ecs" / "ecs.jsonl"
    f.write_text("{}\n")
    assert S.guarded_run(spark, str(tmp_path), lambda: 7) == 7
    with pytest.raises(S.CorpusChangedError, match="ecs"):
        S.guarded_run(spark, str(tmp_path), lambda: f.write_text("{} \n"))


class Kind(Enum):
    A = "alpha"


def test_settings(tmp_path):
    assert config.as_enum(" ALPHA ", Kind) is Kind.A and config.as_enum(None, Kind, Kind.A) is Kind.A and config.as_text(None, "d") == "d"
    assert str(config.as_path("a/b", "/base")) == "/base/a/b" and str(config.as_path("/x", "/base")) == "/x"
    for f, v in ((config.as_enum, ("x", Kind)), (config.as_text, (3,)), (config.as_path, (" ",))):
        with pytest.raises(ValueError, match="x|3|path"):
            f(*v)
    made = config.merged({"model": {"top_p": 0.5}}, config.from_environment({"P_" + k: v for k, v in config.ENVIRONMENT.items()}, {"P_MODEL_TOP_P": "1.5", "P_LOG_OUTPUT": "file"}))
    assert len(config.ENVIRONMENT) == 19 and dict(config.faults(made)) == {"model.top_p": "must be above 0 and at most 1", "logging.file_path": "is needed where logging.output is file"}
    assert list(config.faults({})) == [] and config.checked({"model": {"max_retries": 0}})
    bad = {"engine": {"name": " ", "max_concurrent_requests": 0}, "model": {"temperature": "hot", "max_output_tokens": 0}, "security": {"required_secrets": ["a", "a", " "], "secrets_provider": "file"}, "paths": {"prompts_dir": str(tmp_path / "no")}}
    assert {k for k, _ in config.faults(bad, True)} == {"engine.name", "engine.max_concurrent_requests", "model.temperature", "model.max_output_tokens", "security.required_secrets", "security.secrets_file", "paths.prompts_dir"}
    with pytest.raises(ValueError, match="engine.name"):
        config.checked(bad)
