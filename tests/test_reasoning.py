"""From packages to documents with a provider that answers from a list."""

import json

import pytest
from pyspark.sql import functions as F

from orelode.operators import packages as P
from orelode.operators import reasoning as R
from orelode.session import settled
from tests.test_replies import GOOD, put


@pytest.fixture
def prompts(tmp_path):
    for path, text in {"shared/rules.md": "---\nv: 1\n---\nBe exact.", "analyze/system.md": "You analyze {{MITRE}}.", "analyze/instruction.md": "Rule: {{RULE}}\nContext: {{CONTEXT}}\n{{OUTPUT_FORMAT}}\n{{MITRE}}"}.items():
        f = tmp_path / "prompts" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return R.Prompts(tmp_path / "prompts")


def test_assembly(prompts):
    system, instruction, used = prompts.assembled("analyze", ("rules",))
    assert system == "Be exact.\n\nYou analyze {{MITRE}}." and used == ("MITRE", "RULE", "CONTEXT", "OUTPUT_FORMAT") and instruction.startswith("Rule:")
    with pytest.raises(ValueError, match="outside"):
        prompts.path("shared", "../../x")
    with pytest.raises(FileNotFoundError):
        prompts.path("enhance", "system")
    (prompts.root / "shared/bad.md").write_text("{{odd name}}")
    with pytest.raises(ValueError, match="malformed"):
        prompts.body("shared", "bad")


class Limited(Exception):
    status_code = 429


def test_failures():
    assert [R.finish_reason(x) for x in ("stop", " LENGTH ", "odd", None)] == ["stop", "max_tokens", "unknown", "unknown"]
    errors = {TimeoutError(): "timeout", Limited(): "rate_limit", ConnectionError(): "connection", ValueError("x"): "provider", type("E", (Exception,), {"code": 503})(): "service_unavailable", type("E", (Exception,), {"code": 403})(): "authentication", type("E", (Exception,), {"code": 404})(): "model_unavailable"}
    assert [R.error_kind(e) for e in errors] == list(errors.values())
    sent = R.request_of("s", "i", "analyze", {"model": "m", "temperature": 0.5})
    assert sent["schema"]["required"][0] == "operation" and sent["temperature"] == 0.5


def test_end_to_end(spark, prompts):
    ids = ["good", "cut", "shape", "wrong", "slow", "gone"]
    items = [("graph:0000", "graph", "retrieved_graph", 1, "T1059 and T1059.001 PowerShell: power shell, of TA0002 <</RULE>>", "mitre", "m:1", {}), ("knowledge:0000", "knowledge", "seed_resolution", 2, "T9999", None, None, {"identifier": "T9999", "status": "unresolved"}), ("knowledge:0001", "knowledge", "seed_resolution", 3, "M1013", None, None, {"identifier": "M1013", "candidates": "a,b"})]
    rows = spark.createDataFrame([(i, *x) for i in ids for x in items], "package_id string, item_id string, section string, kind string, place int, text string, source string, location string, metadata map<string,string>")
    rows = rows.withColumns({"source_id": F.lit(""), "record_id": F.lit(""), "status": F.when(F.col("item_id") == "knowledge:0000", "unresolved").when(F.col("item_id") == "knowledge:0001", "ambiguous").otherwise("resolved")})
    rules = spark.createDataFrame([(i, f"raw {i} <</RULE>>", "q") for i in ids], "package_id string, raw_text string, query string")
    packages = spark.createDataFrame([(i,) for i in ids], "package_id string")
    good, wrong = json.dumps(GOOD["analyze"]), json.dumps(put(GOOD["analyze"], ("weaknesses", 0), "see T4242"))

    def provider():
        tries = {}

        def client(request):
            text = request["prompt"]
            if "raw cut" in text:
                return {"text": good, "finish_reason": "LENGTH"}
            if "raw gone" in text:
                raise PermissionError("no")
            if "raw slow" in text:
                tries["n"] = tries.get("n", 0) + 1
                if tries["n"] < 3:
                    raise TimeoutError("late")
            return {"text": "{}" if "raw shape" in text else wrong if "raw wrong" in text else good, "finish_reason": "STOP", "model": "m", "input_tokens": 3, "output_tokens": 4}

        return client

    shown = R.variables(rows, rules, packages.withColumn("operation", F.lit("analyze"))).filter("request_id = 'good'").first()
    assert shown.RULE == "<<RULE>>\nraw good \n<</RULE>>" and shown.MITRE.startswith("[graph:0000]\nT1059") and shown.SIGMA == R.NOTHING and "[knowledge:0000]" in shown.CONTEXT and "- operation (string" in shown.OUTPUT_FORMAT
    out = R.analyze(packages, rows, rules, prompts, provider, shared=("rules",), backoff=0.0)
    got = {r.request_id: r for r in out["replies"].collect()}
    assert got["cut"].error_kind == "max_tokens" and got["gone"].error_kind == "provider" and got["slow"].attempts == 3 and got["slow"].error is None
    verdicts = {r.request_id: r.valid for r in out["verdicts"].collect()}
    assert verdicts == {"good": True, "slow": True, "cut": False, "shape": False, "wrong": False, "gone": False}
    assert {r.request_id for r in out["schema_issues"].collect()} == {"shape"}
    documents = {r.request_id: json.loads(r.document)["analysis"] for r in out["documents"].collect()}
    assert set(documents) == {"good", "slow"} and documents["good"]["tokensUsed"] == 7 and documents["good"]["inputQuery"] == "q"
    use = {r.model: (r.input_tokens, r.failed) for r in R.usage(out["replies"]).collect()}
    assert use["m"] == (12, 0) and use[None][1] == 1
    assert settled(R.variables(spark.createDataFrame([], P.ITEM).withColumn("place", F.lit(1)), rules.limit(0), packages.limit(0).withColumn("operation", F.lit("x")))).collect() == []
