"""Queries over packages, typed replies and their checks, and relevance by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import benchmark as B
from orelode.operators import mapping as M
from orelode.operators import packages as P
from orelode.operators import reply_checks as C
from orelode.operators import reply_specs as S
from orelode.operators import rule_parsing as RP
from orelode.plans import builds, graphs, rules
from orelode.plans.evidence import FULL
from orelode.session import settled, spread, table


def rule_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header and detection items of rules, and their references."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"))
    context = P.rule_context(RP.described(parts.selectExpr("p_partkey AS rule_id", f"{FULL} AS text")))
    items = P.rule_batch(context)[0].unionByName(P.reference_batch(context)[0])
    return items.select("package_id", "item_id", "kind", F.md5(F.encode("text", "UTF-8")).alias("digest"))


RULE_ITEMS = """WITH r AS (SELECT p_partkey::VARCHAR AS id, p_partkey % 4 AS k, p_name, p_type, p_size, p_brand FROM part WHERE p_partkey % 4 < 3)
SELECT id AS package_id, 'rule:0000' AS item_id, 'rule_text' AS kind, md5(CASE k WHEN 0 THEN 'Title: ' || p_name || chr(10) || 'Format: sigma' || chr(10) || 'Language: sigma' || chr(10) || 'Log source: category=process_creation, service=7' || chr(10) || 'False positives: none'
WHEN 1 THEN 'Title: ' || p_name || chr(10) || 'Format: elastic' || chr(10) || 'Language: unknown' || chr(10) || 'Log source: indices=i-' || p_size || ',j' || chr(10) || 'False positives: fp' ELSE 'Title: t' || chr(10) || 'Format: sigma' || chr(10) || 'Language: sigma' END) AS digest FROM r
UNION ALL SELECT id, 'rule:0001', 'rule_detection', md5(CASE k WHEN 0 THEN 'Condition: sel or not x' WHEN 1 THEN 'Query:' || chr(10) || 'q' ELSE 'Condition: c' END) FROM r
UNION ALL SELECT id, 'references:0000', 'reference', md5(CASE k WHEN 0 THEN 'http://x' ELSE 'r1' END) FROM r WHERE k < 2 UNION ALL SELECT id, 'references:0001', 'reference', md5('r2') FROM r WHERE k = 1"""


def mapping_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of mapped entities, 50 packages of them, with their warnings' number."""
    mapped = settled(M.mapped(rules.entities(spark, sf_dir)).withColumns({"package_id": (F.col("event_id") % 50).cast("string"), "ordinal": F.col("event_id")}))
    items, warnings = P.mapping_batch(mapped)
    told = warnings.groupBy("package_id").agg(F.count(F.lit(1)).alias("warnings"))
    return items.join(told, "package_id").select("package_id", "item_id", "text", "status", "warnings")


MAPPING_ITEMS = f"""WITH c AS ({rules.CANONICAL_FORMS}), v AS (SELECT c.*, e.value, event_id % 50 AS p FROM c JOIN ({rules.SQL_ENTITIES}) e USING (event_id)), n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY event_id) - 1 AS pos FROM v),
w AS (SELECT p, count(*) AS warnings FROM v WHERE status = 'unresolved' GROUP BY p)
SELECT n.p::VARCHAR AS package_id, 'mappings:' || lpad(pos::VARCHAR, greatest(4, length(pos::VARCHAR))::INT, '0') AS item_id, canonical_type || ': ' || coalesce(nullif(canonical_id, ''), nullif(canonical_value, ''), '-') || ' (original=''' || value || ''', status=' || status || ', method=' || method || ')' || coalesce(' note=' || note, '') AS text,
CASE WHEN status = 'unresolved' THEN 'unresolved' ELSE 'resolved' END AS status, warnings FROM n JOIN w USING (p)"""


def seed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and warnings of the seeds of 40 queries."""
    items, warnings = P.seed_batch(settled(graphs.seed_reports(spark, sf_dir)))
    told = warnings.select("package_id", "item_id", F.col("code").alias("warning"), "detail")
    return items.join(told, ["package_id", "item_id"], "left").select("package_id", "item_id", "text", "status", "warning", "detail")


SEED_ITEMS = f"""WITH {graphs.SEEDS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal) - 1 AS pos, coalesce(len(node_ids), 0) AS k FROM reports)
SELECT query_id::VARCHAR AS package_id, 'knowledge:' || lpad(pos::VARCHAR, greatest(4, length(pos::VARCHAR))::INT, '0') AS item_id, 'identifier ' || value || coalesce(' -> ' || successor, '') || ': ' || status || ' (candidates: ' || CASE WHEN k > 0 THEN array_to_string(node_ids, ', ') ELSE 'none' END || ')' AS text, status,
CASE status WHEN 'redirected' THEN 'redirected_reference' WHEN 'ambiguous' THEN 'ambiguous_reference' WHEN 'unresolved' THEN 'unresolved_reference' END AS warning,
CASE status WHEN 'redirected' THEN value || ' was withdrawn for ' || successor || ', which the corpus has' WHEN 'ambiguous' THEN value || ' names ' || k || ' records, of which none is taken' WHEN 'unresolved' THEN value || ' names no record' END AS detail FROM n"""

#: A reply for each part, sound but for one thing that its key decides.
CITE = """{"item_id": "', CASE WHEN k = 1 THEN 'none' ELSE 'graph:0000' END, '", "source": "', CASE WHEN k = 2 THEN 'ecs' ELSE 'mitre' END, '", "identifier": "', CASE WHEN k = 3 THEN 'T7777' ELSE 'T1059' END, '", "detail": "d"}"""
REPLY = f"""concat('{{"operation": "analyze", "summary": "', CASE WHEN k = 4 THEN ' ' ELSE p_type END, '", "findings": [{{"finding_id": "F1", "category": "logic", "severity": "high", "statement": "s", "explanation": "', CASE WHEN k = 5 THEN 'see CVE-2020-1234' ELSE 'e' END, '", "support": "supported", "evidence": [',
 CASE WHEN k = 6 THEN '' ELSE concat('{CITE}') END, '], "confidence": ', CASE WHEN k = 7 THEN '2.5' ELSE '0.5' END, '}}], "recommendations": [{{"recommendation_id": "R1", "category": "noise", "priority": "low", "action": "a", "rationale": "r", "addresses": ["', CASE WHEN k = 8 THEN 'F9' ELSE 'F1' END, '"], "support": "supported", "code_snippet": ""}}], "confidence": 1, "metadata": {{}}, "uncertainties": [',
 CASE WHEN k = 9 THEN '' ELSE concat('{{"identifier": "T9999", "status": "', CASE WHEN k = 10 THEN 'ambiguous' ELSE 'unresolved' END, '", "candidates": [', CASE WHEN k = 10 THEN '"a"' ELSE '' END, '], "treatment": "t"}}') END,
 '], "score": ', CAST(CASE WHEN k = 11 THEN 101 ELSE p_size END AS STRING), ', "fp_risk": "low", "strengths": ["', CASE WHEN k = 12 THEN 'password=abcdefgh' WHEN k = 13 THEN 'http://a.b/c' WHEN k = 14 THEN '{{{{X}}}}' ELSE 's' END, '"], "weaknesses": [], "evasion_risks": [], "mappings": []}}')"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")).selectExpr("CAST(p_partkey AS STRING) AS request_id", "'analyze' AS operation", "p_type", "p_size", "p_partkey % 16 AS k")
    return S.typed(rows.selectExpr("request_id", "operation", f"CASE WHEN k = 15 THEN 'broken' ELSE {REPLY} END AS reply"))


def reply_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply's verdict and its issues, against packages of two items and one uncertain identifier."""
    typed = settled(replies(spark, sf_dir))
    ids = typed.select(F.col("request_id").alias("package_id"))
    none = F.lit(None).cast("string")
    items = ids.select("package_id", F.lit("graph:0000").alias("item_id"), F.lit("retrieved_graph").alias("kind"), F.lit(1).alias("place"), F.lit("T1059 is here").alias("text"), F.lit("mitre").alias("source"), F.lit("m:1").alias("location"), F.lit("resolved").alias("status"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"), none.alias("source_id"), none.alias("record_id"))
    seeds = ids.select("package_id", F.lit("knowledge:0000").alias("item_id"), F.lit("seed_resolution").alias("kind"), F.lit(2).alias("place"), F.lit("T9999").alias("text"), none.alias("source"), none.alias("location"), F.lit("unresolved").alias("status"), F.create_map(F.lit("identifier"), F.lit("T9999")).alias("metadata"), none.alias("source_id"), none.alias("record_id"))
    given = C.supplied(items.unionByName(seeds), ids.select("package_id", F.lit("raw").alias("raw_text"), F.lit("q").alias("query")))
    out = C.verdicts(typed, C.checked(typed, given))
    return out.select("request_id", "errors", "warnings", "valid", F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["category"], i["path"], i["code"])), ";").alias("issues"))


REPLY_CHECKS = """SELECT p_partkey::VARCHAR AS request_id, CASE k WHEN 0 THEN 0 WHEN 10 THEN 2 ELSE 1 END::BIGINT AS errors, 0::BIGINT AS warnings, k = 0 AS valid,
['', 'evidence findings[0].evidence[0].item_id unknown_item', 'provenance findings[0].evidence[0].source source_mismatch', 'evidence findings[0].evidence[0].identifier fabricated_identifier', 'structure summary missing_value', 'evidence findings[0].explanation fabricated_identifier',
 'evidence findings[0].evidence unsupported_claim', 'structure findings[0].confidence out_of_range', 'structure recommendations[0].addresses[0] unknown_reference', 'uncertainty uncertainties uncertainty_dropped', 'uncertainty uncertainties[0].candidates fabricated_candidate;uncertainty uncertainties[0].status uncertainty_changed',
 'structure score out_of_range', 'security strengths[0] credential', 'security strengths[0] fabricated_reference', 'security strengths[0] template_mark', 'structure $ no_result'][k + 1] AS issues FROM (SELECT *, p_partkey % 16 AS k FROM part)"""


def reply_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the replies whose score is one, and what they say of it."""
    rows = replies(spark, sf_dir).filter("result.score BETWEEN 0 AND 100").withColumns({"result_id": F.lit("id"), "rule_id": F.col("request_id"), "input_query": F.lit("q"), "model": F.lit("m"), "tokens": F.lit(7), "latency_ms": F.lit(5), "user_id": F.lit("u"), "created_at": F.lit("now"), "saved": F.lit(False), "saved_rule_id": F.lit(None).cast("string"), "saved_rule_title": F.lit("")})
    doc = lambda path: F.get_json_object("document", f"$.analysis.{path}")
    return S.documents(rows).select("request_id", doc("ruleId").alias("rule_id"), doc("score").alias("score"), doc("rating").alias("rating"), doc("fpRisk").alias("fp_risk"), doc("feedback").alias("feedback"), doc("findings[0].category").alias("category"), doc("suggestions[0].priority").alias("priority"), doc("tokensUsed").alias("tokens"), doc("mitreMappings").alias("mappings"))


REPLY_DOCUMENTS = """SELECT p_partkey::VARCHAR AS request_id, p_partkey::VARCHAR AS rule_id, p_size::VARCHAR AS score, CASE WHEN p_size >= 50 THEN 'C' WHEN p_size >= 30 THEN 'D' ELSE 'F' END AS rating, 'low' AS fp_risk, CASE WHEN p_partkey % 16 = 4 THEN ' ' ELSE p_type END AS feedback, 'logic_error' AS category, '4' AS priority, '7' AS tokens, '[]' AS mappings
FROM part WHERE p_partkey % 16 NOT IN (11, 15)"""


def truth_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of cases of five rules over the records of ``builds``."""
    n = table(spark, sf_dir, "nation")
    case = lambda expr: n.selectExpr(*expr)
    ident = "concat('t', CAST(1000 + n_nationkey AS STRING), ' ')"
    rows = case(["concat('a', CAST(n_nationkey AS STRING)) AS case_id", "'attack_technique' AS rule", f"{ident} AS anchor"])
    rows = rows.unionByName(case(["concat('n', CAST(n_nationkey AS STRING)) AS case_id", "'technique_name' AS rule", "lower(n_name) AS anchor"]))
    rows = rows.unionByName(n.filter("n_nationkey % 7 = 3").selectExpr("concat('m', CAST(n_nationkey AS STRING)) AS case_id", "'all_candidates' AS rule", f"{ident} AS anchor"))
    rows = rows.unionByName(case(["concat('u', CAST(n_nationkey AS STRING)) AS case_id", "CASE WHEN n_nationkey = 0 THEN 'citing_records_only' ELSE 'none_expected' END AS rule", "'T9999' AS anchor"]))
    out = B.truth(rows.withColumn("ordinal", F.lit(0)), settled(builds.records(spark, sf_dir)))
    return out.select("case_id", "record_id", "grade")


TRUTH_BY_RULE = f"""WITH {builds.RECORDS}, cite AS (SELECT DISTINCT source || ':' || substr(sid, 2) AS record_id, value FROM refs WHERE field IN ('mitreTechniques', 'mitre.techniqueId', 'mitreTechnique')),
cases AS (SELECT n_nationkey AS n, 'T' || (1000 + n_nationkey) AS t, lower(n_name) AS name FROM nation),
g AS (SELECT 'a' || n AS case_id, id AS record_id, 3 AS grade, '' AS key, 1 AS part FROM cases JOIN mitre ON aid = t UNION ALL SELECT 'a' || n, record_id, 2, '', 2 FROM cases JOIN cite ON value = t
    UNION ALL SELECT 'n' || c.n, m.id, 3, m.id, 1 FROM cases c JOIN mitre m ON lower(trim(m.name)) = c.name UNION ALL SELECT 'n' || c.n, cite.record_id, 1, m.id, 2 FROM cases c JOIN mitre m ON lower(trim(m.name)) = c.name JOIN cite ON cite.value = m.aid
    UNION ALL SELECT 'm' || n, id, 3, '', 1 FROM cases JOIN mitre ON aid = t WHERE n % 7 = 3 UNION ALL SELECT 'u0', record_id, 2, '', 1 FROM cite WHERE value = 'T9999')
SELECT case_id, record_id, arg_min(grade, key || part)::INT AS grade FROM g GROUP BY ALL"""

QUERIES = {
    "rule_items": (rule_items, RULE_ITEMS),
    "mapping_items": (mapping_items, MAPPING_ITEMS),
    "seed_items": (seed_items, SEED_ITEMS),
    "reply_checks": (reply_checks, REPLY_CHECKS),
    "reply_documents": (reply_documents, REPLY_DOCUMENTS),
    "truth_by_rule": (truth_by_rule, TRUTH_BY_RULE),
}
