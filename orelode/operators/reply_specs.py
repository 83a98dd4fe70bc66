"""The closed schemas of the three operations' replies, and what is made of a reply that keeps to its own.

A schema is a tuple of fields. It gives the prompt's listing, a skeleton, a JSON schema, and the type that a checked reply
is read into: one struct with the fields of all operations, null where another operation has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import checks as K
from orelode.operators.replies import Field, json_schema

OPERATIONS = ("analyze", "enhance", "generate")
#: Values and names that callers and models rely on: fixed values.
DIMENSIONS = ("logic", "fields", "false_positives", "false_negatives", "evasion", "brittleness", "mitre_coverage", "noise", "documentation")
LEVELS = ("critical", "high", "medium", "low")
SUPPORT = ("supported", "partially_supported", "unsupported")
SOURCES = ("mitre", "sigma", "elastic", "lolbas", "ecs", "rule", "entities", "context")
CHANGES = ("correctness", "evasion_resistance", "false_positive_reduction", "coverage", "documentation", "metadata")
ASPECTS = ("target_behaviour", "data_source", "query_language", "query_logic", "metadata", "documentation")
TYPES, LANGUAGES = ("query", "threshold", "eql", "new_terms", "esql"), ("kql", "eql", "esql", "lucene")
INTERVAL, FROM_TIME, MAX_SIGNALS = "5m", "now-6m", 100


def text(name: str, *enum: str, empty: bool = False, lines: bool = False) -> Field:
    return Field(name, "string", enum=enum, empty=empty, lines=lines)


def share(name: str) -> Field:
    return Field(name, "number", least=0.0, most=1.0)


def whole(name: str) -> Field:
    return Field(name, "integer", least=0, most=100)


def listed(name: str, fields: tuple[Field, ...], least: int = 0) -> Field:
    return Field(name, "objects", fields=fields, min_items=least)


def strings(name: str) -> Field:
    return Field(name, "strings")


EVIDENCE = (text("item_id"), text("source", *SOURCES), text("identifier", empty=True), text("detail"))
UNCERTAINTY = (text("identifier"), text("status", "unresolved", "ambiguous"), strings("candidates"), text("treatment"))
FINDING = (text("finding_id"), text("category", *DIMENSIONS), text("severity", *LEVELS), text("statement"), text("explanation"), text("support", *SUPPORT), listed("evidence", EVIDENCE), share("confidence"))
RECOMMENDATION = (text("recommendation_id"), text("category", *DIMENSIONS), text("priority", *LEVELS), text("action"), text("rationale"), strings("addresses"), text("support", *SUPPORT), text("code_snippet", empty=True, lines=True))
MITRE = (text("tactic_id", empty=True), text("tactic_name", empty=True), text("technique_id"), text("technique_name", empty=True), share("confidence"), text("parent_technique_id", empty=True), text("parent_technique_name", empty=True))
RULE = (text("title"), text("description"), text("rule_type", *TYPES), text("language", *LANGUAGES), text("query"), text("severity", *LEVELS), whole("risk_score"), strings("index_patterns"), strings("false_positives"), strings("tags"), text("investigation_guide"), listed("mitre", MITRE))
ORIGINAL = (text("identifier", empty=True), text("title"), text("language", empty=True), text("query"))
CHANGE = (text("change_id"), text("category", *CHANGES), text("before", empty=True), text("after", empty=True), text("rationale"), strings("addresses"), listed("evidence", EVIDENCE), text("support", *SUPPORT))
RATIONALE = (text("aspect", *ASPECTS), text("statement"), text("rationale"), listed("evidence", EVIDENCE))
CLAIM = (*MITRE, text("support", *SUPPORT), listed("evidence", EVIDENCE))
EVASION = (text("technique"), text("description"), text("mitigation"))


def envelope(operation: str) -> tuple[Field, ...]:
    return (Field("operation", "string", const=operation), text("summary"), listed("findings", FINDING), listed("recommendations", RECOMMENDATION), share("confidence"), Field("metadata", "map"), listed("uncertainties", UNCERTAINTY))


SPECS = {
    "analyze": (*envelope("analyze"), whole("score"), text("fp_risk", *LEVELS), strings("strengths"), strings("weaknesses"), listed("evasion_risks", EVASION), listed("mappings", CLAIM)),
    "enhance": (*envelope("enhance"), Field("original_rule", "object", fields=ORIGINAL), Field("enhanced_rule", "object", fields=RULE), listed("changes", CHANGE, 1)),
    "generate": (*envelope("generate"), Field("generated_rule", "object", fields=RULE), listed("rationale", RATIONALE, 1), listed("mappings", CLAIM), whole("score"), text("notes", empty=True)),
}
ALL = tuple({f.name: f for spec in SPECS.values() for f in spec}.values())


def sql_type(fields: tuple[Field, ...]) -> str:
    kinds = {"string": "string", "integer": "int", "number": "double", "strings": "array<string>", "map": "map<string,string>"}
    one = lambda f: kinds.get(f.kind) or (sql_type(f.fields) if f.kind == "object" else f"array<{sql_type(f.fields)}>")
    return "struct<" + ",".join(f"{f.name}:{one(f)}" for f in fields) + ">"


def typed(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``replies`` with ``result``, their text read into the type of all operations; null if it is no JSON object."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False))
    return replies.withColumn("result", F.when(whole, F.from_json(column, sql_type(ALL))))


def prompt_text(fields: tuple[Field, ...], depth: int = 0) -> str:
    """A line for each field: its name, kind and limits; nested ones below it."""
    lines = []
    for f in fields:
        limits = [f"exactly '{f.const}'" if f.const else "", "one of " + ", ".join(f.enum) if f.enum else "", f"{f.least:g} to {f.most:g}" if f.least is not None and f.most is not None else "", f"at least {f.min_items}" if f.min_items else "", "may be empty" if f.empty else "", "may have lines" if f.lines else ""]
        said = "; ".join(x for x in limits if x)
        lines.append(f"{'  ' * depth}- {f.name} ({f.kind}{'; ' + said if said else ''})")
        if f.fields:
            lines.append(prompt_text(f.fields, depth + 1))
    return "\n".join(lines)


def skeleton(fields: tuple[Field, ...]) -> dict:
    """A document of the schema's shape with placeholders."""
    plain = {"integer": 0, "number": 0.0, "strings": [], "map": {}}
    return {f.name: f.const or (f.enum[0] if f.enum else "") if f.kind == "string" else skeleton(f.fields) if f.kind == "object" else [skeleton(f.fields)] if f.kind == "objects" else plain[f.kind] for f in fields}


def schema_of(operation: str) -> dict:
    return json_schema(SPECS[operation])


def mapping(m: Column) -> Column:
    """A technique in the documents' shape: with a parent it is the sub-technique of that."""
    has = stripped(m["parent_technique_id"]) != ""
    return F.struct(
        m["tactic_id"].alias("tacticId"), m["tactic_name"].alias("tacticName"), F.when(has, stripped(m["parent_technique_id"])).otherwise(m["technique_id"]).alias("techniqueId"), F.when(has, m["parent_technique_name"]).otherwise(m["technique_name"]).alias("techniqueName"),
        F.when(has, m["technique_id"]).alias("subTechniqueId"), F.when(has, m["technique_name"]).alias("subTechniqueName"), F.bround(m["confidence"] * 100).cast("int").alias("confidence"),
    )


def documents(replies: DataFrame) -> DataFrame:
    """``request_id, document``: the JSON document of each reply.

    Replies have ``result`` and what the run knows: ``operation, result_id, rule_id, input_query, model, tokens,
    latency_ms, user_id, created_at, saved, saved_rule_id, saved_rule_title``. A result of another operation is an error.
    """
    r = F.col("result")
    own = lambda name, column: F.col(column).alias(name)
    head = [own("id", "result_id"), own("ruleId", "rule_id"), own("analysisType", "operation")]
    run = [own("modelUsed", "model"), own("tokensUsed", "tokens"), own("latencyMs", "latency_ms"), own("userId", "user_id"), own("createdAt", "created_at")]
    none = F.array().cast("array<string>").alias("references")
    findings = F.transform(r["findings"], lambda f: F.struct(K.looked_up(K.CATEGORY, f["category"]).alias("category"), f["severity"].alias("severity"), f["statement"].alias("title"), f["explanation"].alias("detail")))
    suggestions = F.transform(r["recommendations"], lambda s: F.struct(K.looked_up(K.PRIORITY, s["priority"]).alias("priority"), s["action"].alias("title"), s["rationale"].alias("description"), s["code_snippet"].alias("codeSnippet")))
    analyze = F.struct(
        *head, own("inputQuery", "input_query"), F.lit("").alias("outputQuery"), r["score"].alias("score"), K.rating(r["score"]).alias("rating"), K.looked_up(K.FP_RISK, r["fp_risk"]).alias("fpRisk"), r["summary"].alias("feedback"), r["strengths"].alias("strengths"), r["weaknesses"].alias("weaknesses"),
        findings.alias("findings"), suggestions.alias("suggestions"), r["evasion_risks"].alias("evasionRisks"), F.transform(r["mappings"], mapping).alias("mitreMappings"), *run,
    )
    rule = r["enhanced_rule"]
    changes = F.transform(r["changes"], lambda c: F.struct(K.change_label(c["before"], c["after"]).alias("change"), c["rationale"].alias("reason")))
    enhance = F.struct(
        *head, r["original_rule"]["query"].alias("inputQuery"), F.lit(0).alias("score"), F.lit("").alias("rating"), *run, rule["query"].alias("enhancedQuery"), changes.alias("changelog"), rule["severity"].alias("newSeverity"), rule["risk_score"].alias("newRiskScore"), rule["investigation_guide"].alias("investigationGuide"),
        rule["false_positives"].alias("falsePositives"), none, rule["index_patterns"].alias("indexPatterns"), F.transform(rule["mitre"], mapping).alias("newMitreMappings"), rule["title"].alias("enhancedTitle"), rule["description"].alias("enhancedDescription"),
    )
    rule = r["generated_rule"]
    generate = F.struct(
        head[0], head[2], *run, *[rule[c].alias(c) for c in ("title", "description", "query")], K.looked_up(K.STORED_LANGUAGE, rule["language"]).alias("language"), rule["rule_type"].alias("ruleType"), rule["severity"].alias("severity"), rule["risk_score"].alias("riskScore"), rule["tags"].alias("tags"), rule["index_patterns"].alias("indexPatterns"),
        F.lit(INTERVAL).alias("interval"), F.lit(FROM_TIME).alias("fromTime"), F.lit(MAX_SIGNALS).alias("maxSignals"), rule["investigation_guide"].alias("investigationGuide"), rule["false_positives"].alias("falsePositives"), none, F.transform(r["mappings"], mapping).alias("mitreMappings"), r["score"].alias("score"), r["notes"].alias("notes"),
    )
    as_json = lambda doc: F.to_json(doc, {"ignoreNullFields": "false"})
    saved = F.concat(F.expr("left(plain, length(plain) - 1)"), F.lit(',"savedRuleId":'), F.coalesce(F.to_json(F.array("saved_rule_id")).substr(F.lit(2), F.length(F.to_json(F.array("saved_rule_id"))) - 2), F.lit("null")), F.lit(',"savedRuleTitle":'), F.to_json(F.array("saved_rule_title")).substr(F.lit(2), F.length(F.to_json(F.array("saved_rule_title"))) - 2), F.lit("}"))
    wrong = F.raise_error(F.format_string("a result of %s can't answer %s", r["operation"], F.col("operation"))).cast("string")
    plain = F.when(~F.coalesce(r["operation"] == F.col("operation"), F.lit(False)), wrong)
    for name, doc in (("analyze", F.struct(analyze.alias("analysis"))), ("enhance", F.struct(enhance.alias("analysis"))), ("generate", F.struct(generate.alias("analysis")))):
        plain = plain.when(F.col("operation") == name, as_json(doc))
    rows = replies.withColumn("plain", plain)
    return rows.select("request_id", F.when((F.col("operation") == "generate") & F.col("saved"), saved).otherwise(F.col("plain")).alias("document"))
