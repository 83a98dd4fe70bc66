"""Queries over a graph that is built from records: the tables' rows with metadata of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import graph as G
from orelode.operators import graph_build as B
from orelode.operators import references as R
from orelode.session import settled, spread, table

T = "concat('T', CAST({} AS STRING))".format
#: Table, and its record's source, line, id, source id and metadata; nations of key 3 in 7 are in two domains.
TABLES = (
    ("nation", "mitre", "n_nationkey + 1", "concat('mitre:ent:', CAST(n_nationkey AS STRING))", f"concat('ent:', {T('1000 + n_nationkey')})", f"named_struct('objectType', 'technique', 'techniqueId', {T('1000 + n_nationkey')}, 'techniqueName', n_name, 'domain', 'ent', 'tactics', array(named_struct('tacticId', concat('ta000', CAST(n_regionkey AS STRING)))), 'parentTechniqueId', CASE WHEN n_nationkey % 5 > 0 THEN {T('1000 + n_nationkey - n_nationkey % 5')} END)"),
    ("nation", "mitre", "n_nationkey + 101", "concat('mitre:mob:', CAST(n_nationkey AS STRING))", f"concat('mob:', {T('1000 + n_nationkey')})", f"named_struct('objectType', CASE WHEN n_nationkey % 7 = 3 THEN 'technique' WHEN n_nationkey % 7 = 4 THEN 'matrix' END, 'techniqueId', CASE WHEN n_nationkey % 7 = 3 THEN {T('1000 + n_nationkey')} ELSE {T('5000 + n_nationkey')} END, 'techniqueName', n_name, 'domain', 'mob')"),
    ("region", "mitre", "r_regionkey + 201", "concat('mitre:ta:', CAST(r_regionkey AS STRING))", "concat('ent:TA000', CAST(r_regionkey AS STRING))", "named_struct('objectType', 'tactic', 'id', concat('TA000', CAST(r_regionkey AS STRING)), 'name', r_name, 'url', concat('http://e.org/', r_name))"),
    ("customer", "sigma", "c_custkey", "concat('sigma:', CAST(c_custkey AS STRING))", "concat('s', CAST(c_custkey AS STRING))", f"named_struct('title', c_name, 'ruleId', concat('r', CAST(c_custkey - c_custkey % 2 AS STRING)), 'level', 'high', 'mitreTechniques', array({T('1000 + c_nationkey')}, CASE c_custkey % 4 WHEN 0 THEN 'T9999' WHEN 1 THEN {T('5000 + c_nationkey')} ELSE {T('1000 + c_nationkey')} END), 'tags', array(c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN concat('cve.2021.', CAST(10000 + c_nationkey AS STRING)) ELSE ' ' END))"),
    ("supplier", "elastic", "s_suppkey", "concat('elastic:', CAST(s_suppkey AS STRING))", "concat('e', CAST(s_suppkey AS STRING))", f"named_struct('ruleName', s_name, 'severity', 'low', 'type', 'query', 'mitre', array(named_struct('tacticId', concat('TA000', CAST(s_nationkey % 6 AS STRING)), 'techniqueId', {T('1000 + s_nationkey')})))"),
    ("part", "lolbas", "p_partkey", "concat('lolbas:', CAST(p_partkey AS STRING))", "concat('l', CAST(p_partkey AS STRING))", f"named_struct('binary', p_name, 'platform', p_type, 'mitreTechnique', {T('1000 + p_size')})"),
)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, source, line, ident, source_id, metadata in TABLES:
        rows = spread(table(spark, sf_dir, name)).selectExpr(f"'{source}' AS source", f"CAST({line} AS BIGINT) AS line_number", f"{ident} AS id", f"{source_id} AS source_id", "'' AS text", f"parse_json(to_json({metadata})) AS metadata")
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = B.built(records(spark, sf_dir))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return nodes.select("node_id", "node_type", "source", "source_id", "canonical_id", "name", listed("properties").alias("properties"), F.col("evidence")["prov_line"].alias("line"))


def graph_build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _ = B.built(records(spark, sf_dir))
    return edges.select("key", "type", "start_id", "end_id", *[F.col("evidence")[k].alias(k) for k in ("source_location", "original_value", "canonical_id", "resolution_status", "origin", "evidence")])


def graph_build_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    _, _, skipped = B.built(rows)
    skipped = settled(skipped)
    out = R.listed(skipped, B.skipped_candidates(rows, skipped)).drop("candidate_set")
    return out.withColumn("candidates", F.array_join("candidates", ","))


RECORDS = """mitre AS (SELECT 'mitre:ent:' || n_nationkey AS id, 'ent:T' || (1000 + n_nationkey) AS sid, 'T' || (1000 + n_nationkey) AS aid, n_name AS name, 'domain=ent;' AS dom, 'technique' AS kind, n_nationkey + 1 AS line FROM nation
    UNION ALL SELECT 'mitre:mob:' || n_nationkey, 'mob:T' || (1000 + n_nationkey), CASE WHEN n_nationkey % 7 = 3 THEN 'T' || (1000 + n_nationkey) ELSE 'T' || (5000 + n_nationkey) END, n_name, 'domain=mob;', CASE WHEN n_nationkey % 7 = 3 THEN 'technique' END, n_nationkey + 101 FROM nation
    UNION ALL SELECT 'mitre:ta:' || r_regionkey, 'ent:TA000' || r_regionkey, 'TA000' || r_regionkey, r_name, '', 'tactic', r_regionkey + 201 FROM region),
own AS (SELECT 'mitre:' || kind || ':' || sid AS node_id, kind AS node_type, 'mitre' AS source, sid AS source_id, sid AS canonical_id, name, 'attackId=' || aid || ';' || dom || 'objectType=' || kind || CASE WHEN kind = 'tactic' THEN ';url=http://e.org/' || name ELSE '' END AS properties, line::VARCHAR AS line, id FROM mitre WHERE kind IS NOT NULL
    UNION ALL SELECT 'sigma:rule:r' || (c_custkey - c_custkey % 2), 'rule', 'sigma', 's' || c_custkey, 'r' || (c_custkey - c_custkey % 2), c_name, 'category=sigma;level=high', c_custkey::VARCHAR, 'sigma:' || c_custkey FROM customer
    UNION ALL SELECT 'elastic:rule:e' || s_suppkey, 'rule', 'elastic', 'e' || s_suppkey, 'e' || s_suppkey, s_name, 'category=elastic;level=low;ruleType=query', s_suppkey::VARCHAR, 'elastic:' || s_suppkey FROM supplier
    UNION ALL SELECT 'lolbas:lolbas_entry:l' || p_partkey, 'lolbas_entry', 'lolbas', 'l' || p_partkey, 'l' || p_partkey, p_name, 'platform=' || p_type, p_partkey::VARCHAR, 'lolbas:' || p_partkey FROM part),
refs AS (SELECT 'mitre' AS source, 'ent:T' || (1000 + n_nationkey) AS sid, 'mitre:technique:ent:T' || (1000 + n_nationkey) AS start_id, 'technique' AS start_type, 'tactics.tacticId' AS field, 'TA000' || n_regionkey AS value FROM nation
    UNION ALL SELECT 'mitre', 'ent:T' || (1000 + n_nationkey), 'mitre:technique:ent:T' || (1000 + n_nationkey), 'technique', 'parentTechniqueId', 'T' || (1000 + n_nationkey - n_nationkey % 5) FROM nation WHERE n_nationkey % 5 > 0
    UNION ALL SELECT 'sigma', 's' || c_custkey, 'sigma:rule:r' || (c_custkey - c_custkey % 2), 'rule', 'mitreTechniques', unnest(['T' || (1000 + c_nationkey), CASE c_custkey % 4 WHEN 0 THEN 'T9999' WHEN 1 THEN 'T' || (5000 + c_nationkey) ELSE 'T' || (1000 + c_nationkey) END]) FROM customer
    UNION ALL SELECT 'elastic', 'e' || s_suppkey, 'elastic:rule:e' || s_suppkey, 'rule', 'mitre.tacticId', 'TA000' || (s_nationkey % 6) FROM supplier
    UNION ALL SELECT 'elastic', 'e' || s_suppkey, 'elastic:rule:e' || s_suppkey, 'rule', 'mitre.techniqueId', 'T' || (1000 + s_nationkey) FROM supplier
    UNION ALL SELECT 'lolbas', 'l' || p_partkey, 'lolbas:lolbas_entry:l' || p_partkey, 'lolbas_entry', 'mitreTechnique', 'T' || (1000 + p_size) FROM part),
byid AS (SELECT aid, count(*) AS n, min(id) AS id, string_agg(id, ',' ORDER BY line) AS ids, min(CASE WHEN kind IS NOT NULL THEN 'mitre:' || kind || ':' || sid END) AS end_id, min(kind) AS end_type FROM mitre GROUP BY aid),
found AS (SELECT refs.*, n, id, ids, end_id, end_type, CASE WHEN n IS NULL THEN 'unresolved_target' WHEN n > 1 THEN 'ambiguous_target' WHEN end_id IS NULL THEN 'target_node_absent' END AS reason FROM refs LEFT JOIN byid ON aid = value),
tags AS (SELECT 's' || c_custkey AS sid, 'sigma:rule:r' || (c_custkey - c_custkey % 2) AS start_id, unnest([c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 'cve.2021.' || (10000 + c_nationkey) END]) AS tag FROM customer)"""
GRAPH_BUILD_NODES = f"""WITH {RECORDS} SELECT node_id, any_value(node_type) AS node_type, any_value(source) AS source, arg_min(source_id, line::BIGINT) AS source_id, any_value(canonical_id) AS canonical_id, arg_min(name, line::BIGINT) AS name, any_value(properties) AS properties, min(line::BIGINT)::VARCHAR AS line FROM own GROUP BY node_id
UNION ALL SELECT DISTINCT 'derived:tag:' || tag, 'tag', NULL, tag, tag, tag, 'scheme=tag', NULL FROM tags WHERE tag IS NOT NULL
UNION ALL SELECT DISTINCT 'derived:external_reference:cve:CVE-2021-' || substr(tag, 10), 'external_reference', NULL, 'CVE-2021-' || substr(tag, 10), 'cve:CVE-2021-' || substr(tag, 10), NULL, 'described=false;identifier=CVE-2021-' || substr(tag, 10) || ';scheme=cve', NULL FROM tags WHERE starts_with(tag, 'cve.')"""
GRAPH_BUILD_EDGES = f"""WITH {RECORDS}, typed AS (SELECT *, CASE WHEN field = 'parentTechniqueId' THEN 'subtechnique_of' WHEN end_type = 'technique' AND start_type IN ('rule', 'lolbas_entry') THEN 'detects' WHEN end_type = 'tactic' THEN 'belongs_to' ELSE 'references' END AS type FROM found WHERE reason IS NULL),
made AS (SELECT start_id || '|' || type || '|' || end_id || '|' || source || '|' || sid || '|' || field || '|' || value AS key, type, start_id, end_id, source || ':' || sid || ':' || field AS source_location, value AS original_value, value AS canonical_id, 'resolved' AS resolution_status, 'resolved_reference' AS origin, id AS evidence FROM typed
    UNION ALL SELECT start_id || '|has_tag|derived:tag:' || tag || '|sigma|' || sid || '|tags|' || tag, 'has_tag', start_id, 'derived:tag:' || tag, 'sigma:' || sid || ':tags', tag, tag, 'not_applicable', 'literal_metadata', '' FROM tags WHERE tag IS NOT NULL
    UNION ALL SELECT start_id || '|references|derived:external_reference:cve:CVE-2021-' || substr(tag, 10) || '|sigma|' || sid || '|tags|' || tag, 'references', start_id, 'derived:external_reference:cve:CVE-2021-' || substr(tag, 10), 'sigma:' || sid || ':tags', tag, 'CVE-2021-' || substr(tag, 10), 'external', 'literal_metadata', 'no source describes it' FROM tags WHERE starts_with(tag, 'cve.'))
SELECT DISTINCT * FROM made"""
GRAPH_BUILD_SKIPPED = f"""WITH {RECORDS} SELECT reason, source, sid AS source_id, field AS source_field, value AS original_value, CASE WHEN reason = 'ambiguous_target' THEN ids ELSE '' END AS candidates,
CASE reason WHEN 'unresolved_target' THEN 'no record has this identifier' WHEN 'ambiguous_target' THEN n || ' records have this identifier' ELSE 'the record stands for no node' END AS note FROM found WHERE reason IS NOT NULL"""


def graph_build_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the graph once its tactics are taken out and some edges lose their evidence's field."""
    nodes, edges, skipped = B.built(records(spark, sf_dir))
    gone = F.map_concat(F.map_filter("evidence", lambda k, _: k != "source_field"), F.create_map(F.lit("source_field"), F.lit("")))
    edges = edges.withColumn("evidence", F.when(F.col("type") == "subtechnique_of", gone).otherwise(F.col("evidence")))
    return B.problems(nodes.filter("node_type <> 'tactic'"), edges, skipped).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


GRAPH_BUILD_ISSUES = f"""WITH e AS ({GRAPH_BUILD_EDGES}) SELECT 'dangling_end' AS code, count(*) AS n FROM e WHERE type = 'belongs_to' UNION ALL SELECT 'no_source_field', count(*) FROM e WHERE type = 'subtechnique_of'"""


def graph_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, skipped = B.built(records(spark, sf_dir), ("mitre", "sigma"))
    of = lambda rows, column, names: G.type_counts(rows, column, names).select(F.lit(column).alias("what"), F.col(column).alias("name"), "n")
    return of(nodes, "node_type", G.NODE_TYPES).unionByName(of(edges, "type", G.EDGE_TYPES)).unionByName(B.diagnostics(skipped).select(F.lit("reason").alias("what"), F.col("reason").alias("name"), "n"))


def zero_filled(what: str, column: str, rows: str, names) -> str:
    return f"SELECT '{what}' AS what, v.name, count({column}) AS n FROM (VALUES {', '.join(f'({n!r})' for n in names)}) v(name) LEFT JOIN ({rows}) ON v.name = {column} GROUP BY v.name"


GRAPH_BUILD_COUNTS = " UNION ALL ".join((
    zero_filled("node_type", "node_type", f"SELECT * FROM ({GRAPH_BUILD_NODES}) WHERE source IS NULL OR source IN ('mitre', 'sigma')", G.NODE_TYPES), zero_filled("type", "type", f"SELECT * FROM ({GRAPH_BUILD_EDGES}) WHERE split_part(key, ':', 1) IN ('mitre', 'sigma')", G.EDGE_TYPES), zero_filled("reason", "reason", f"SELECT * FROM ({GRAPH_BUILD_SKIPPED}) WHERE source IN ('mitre', 'sigma')", G.SKIPS),
))

QUERIES = {
    "graph_build_nodes": (graph_build_nodes, GRAPH_BUILD_NODES),
    "graph_build_edges": (graph_build_edges, GRAPH_BUILD_EDGES),
    "graph_build_skipped": (graph_build_skipped, GRAPH_BUILD_SKIPPED),
    "graph_build_issues": (graph_build_issues, GRAPH_BUILD_ISSUES),
    "graph_build_counts": (graph_build_counts, GRAPH_BUILD_COUNTS),
}
