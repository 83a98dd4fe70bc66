"""Queries over what rules ask, prompts, and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.functions.text import one_space
from orelode.operators import checks as K
from orelode.operators import mapping as M
from orelode.operators import query_planning as Q
from orelode.operators import replies as L
from orelode.operators import vocabulary as V
from orelode.plans.rules import SQL_BRANCHES
from orelode.session import table

KIND = "CASE event_id % 3 WHEN 0 THEN 'tag' ELSE 'field' END"
VALUE = """CASE event_id % 12 WHEN 0 THEN concat('attack.t1', lpad(CAST(event_id % 50 AS STRING), 3, '0')) WHEN 3 THEN 'attack.execution' WHEN 6 THEN 'cve-2021-44228' WHEN 9 THEN 'own tag'
WHEN 1 THEN 'Image' WHEN 2 THEN 'CommandLine' WHEN 4 THEN 'source' WHEN 5 THEN concat('made.up.', CAST(event_id % 4 AS STRING)) WHEN 7 THEN 'process.name' WHEN 8 THEN 'type' WHEN 10 THEN 'TargetObject' ELSE 'user.name' END"""
DOCUMENTED = ("process.executable", "registry.path", "process.name", "source", "made.up.1", "user.name")


def rule_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS rule_id", "event_id AS ordinal", f"{KIND} AS entity_type", f"{VALUE} AS value", "'' AS source_field")
    documented = Q.documented_fields(spark.createDataFrame([(f" {d.upper()}",) for d in DOCUMENTED], "field_name string"))
    out = Q.rule_queries(M.mapped(rows), documented)
    return out.select("rule_id", *[F.array_join(c, " ").alias(c) for c in ("entity_ids", "canonical_fields", "lexical_fields")])


RULE_QUERIES = f"""WITH e AS (SELECT user_id AS rule_id, event_id AS ordinal, {KIND} AS entity_type, {VALUE} AS value FROM events),
m AS (SELECT *, CASE entity_type WHEN 'tag' THEN {SQL_BRANCHES["tag"]} ELSE {SQL_BRANCHES["field"]} END AS m FROM e),
renames(key, renamed) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in V.RENAMES.items())}),
f AS (SELECT m.*, CASE WHEN entity_type = 'field' THEN coalesce(m[2], value) END AS name, renamed FROM m LEFT JOIN renames ON key = lower(CASE WHEN entity_type = 'field' THEN coalesce(m[2], value) END)),
a AS (SELECT rule_id, ordinal, CASE WHEN m[4] <> 'unresolved' AND m[1] IN {Q.CORPUS_KEYED} THEN m[3] END AS entity, CASE WHEN m[4] <> 'unresolved' OR lower(name) IN {DOCUMENTED} THEN name END AS lexical,
    CASE WHEN m[4] <> 'unresolved' OR lower(name) IN {DOCUMENTED} THEN CASE WHEN renamed IN {DOCUMENTED} THEN renamed ELSE name END END AS canonical FROM f),
u AS (SELECT rule_id, 'e' AS k, entity AS v, min(ordinal) AS o FROM a WHERE entity IS NOT NULL GROUP BY ALL UNION ALL SELECT rule_id, 'c', canonical, min(ordinal) FROM a WHERE canonical IS NOT NULL GROUP BY ALL UNION ALL SELECT rule_id, 'l', lexical, min(ordinal) FROM a WHERE lexical IS NOT NULL GROUP BY ALL)
SELECT r.rule_id, coalesce(string_agg(v, ' ' ORDER BY o) FILTER (k = 'e'), '') AS entity_ids, coalesce(string_agg(v, ' ' ORDER BY o) FILTER (k = 'c'), '') AS canonical_fields, coalesce(string_agg(v, ' ' ORDER BY o) FILTER (k = 'l'), '') AS lexical_fields
FROM (SELECT DISTINCT rule_id FROM e) r LEFT JOIN u ON u.rule_id = r.rule_id GROUP BY ALL"""

TEMPLATE = "Rule {{ NAME }} of size {{SIZE}}:\n{{EVIDENCE}}\nAgain {{NAME}}."


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = L.rendered(TEMPLATE, {"NAME": F.concat("p_name", F.lit(" {{SIZE}}")), "SIZE": F.col("p_size"), "EVIDENCE": L.fenced(F.concat(F.col("p_type"), F.lit("<</EVIDENCE>>x")), "EVIDENCE")})
    return p.select("p_partkey", text.alias("prompt"))


PROMPTS = """SELECT p_partkey, 'Rule ' || p_name || ' {{SIZE}} of size ' || p_size || ':' || chr(10) || '<<EVIDENCE>>' || chr(10) || p_type || 'x' || chr(10) || '<</EVIDENCE>>' || chr(10) || 'Again ' || p_name || ' {{SIZE}}.' AS prompt FROM part"""

SCHEMA = (L.Field("operation", "string", const="analyze"), L.Field("level", "string", enum=("low", "high")), L.Field("score", "integer", least=0, most=100), L.Field("items", "objects", min_items=1, fields=(L.Field("id", "string"), L.Field("note", "string", empty=True, lines=True))))
REPLY = """CASE p_partkey % 6 WHEN 0 THEN concat('{"operation": "analyze", "level": "low", "score": ', CAST(p_size AS STRING), ', "items": [{"id": "a", "note": ""}]}')
WHEN 1 THEN '{"operation": "analyze", "level": "mid", "score": true, "items": []}' WHEN 2 THEN 'no json' WHEN 3 THEN '{"operation": "other", "level": "high", "score": 101, "items": [{"id": " "}], "more": 1}' WHEN 4 THEN '[1]' ELSE '{"operation": "analyze", "level": "high", "score": 5, "items": [7, {"id": 1, "note": "x"}]}' END"""


def reply_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS request_id", f"{REPLY} AS reply")
    return L.reply_issues(rows, SCHEMA)


REPLY_SCHEMA = """SELECT p_partkey::VARCHAR AS request_id, i[1] AS path, i[2] AS message FROM (SELECT p_partkey, unnest(CASE p_partkey % 6
WHEN 1 THEN [['$.level', 'not one of the allowed values'], ['$.score', 'expected an integer'], ['$.items', 'expected at least 1 item(s)']]
WHEN 2 THEN [['$', 'not valid JSON']] WHEN 4 THEN [['$', 'expected an object']]
WHEN 3 THEN [['$.operation', 'expected analyze'], ['$.score', 'out of range'], ['$.items[0].id', 'string must not be empty'], ['$.items[0].note', 'required field is missing'], ['$.more', 'field is not defined by the schema']]
WHEN 5 THEN [['$.items[0]', 'expected an object'], ['$.items[1].id', 'expected a string'], ['$.items[1].note', 'required field is missing']][1:2] END) AS i FROM part)"""


def normalised_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = """concat(p_brand, ':(   ', p_name, chr(10), '  ) and  "a  ( b )" or ', CASE p_partkey % 2 WHEN 0 THEN '( x )' ELSE '"( open' END)"""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{made} AS query")
    return rows.select("p_partkey", one_space(F.col("query")).alias("plain"), K.unpadded(F.col("query")).alias("unpadded"))


NORMALISED = """SELECT p_partkey, p_brand || ':( ' || p_name || ' ) and "a ( b )" or ' || CASE p_partkey % 2 WHEN 0 THEN '( x )' ELSE '"( open' END AS plain, p_brand || ':(' || p_name || ') and "a ( b )" or ' || CASE p_partkey % 2 WHEN 0 THEN '(x)' ELSE '"( open' END AS unpadded FROM part"""

QUERIES = {
    "rule_queries": (rule_queries, RULE_QUERIES),
    "prompts": (prompts, PROMPTS),
    "reply_schema": (reply_schema, REPLY_SCHEMA),
    "normalised_queries": (normalised_queries, NORMALISED),
}
