"""Queries over entities of rules: reading, routing, shapes and canonical forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import entities as E
from orelode.operators import mapping as M
from orelode.operators import vocabulary as V
from orelode.session import table

#: Values of all kinds, made of the columns of ``events``, in words that both engines take.
KINDS = ("ip_address", "network_port", "file_hash", "registry_key", "tag", "severity", "status", "user", "group", "dns_name", "windows_event_id", "reference", "process", "field", "nothing")
K = f"event_id % {len(KINDS)}"
N = "event_id % 7"
ENTITY_TYPE = f"CASE {K} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
S = "CAST({} AS STRING)".format
VALUES = {
    "ip_address": f"CASE {N} WHEN 0 THEN concat('10.', {S('user_id % 300')}, '.0.1') WHEN 1 THEN concat('192.168.', {S('event_id % 256')}, '.7/24') WHEN 2 THEN concat(' 172.16.5.', {S('user_id % 256')}) WHEN 3 THEN 'not an address' WHEN 4 THEN '10.1.2.3/33' WHEN 5 THEN '01.2.3.4' ELSE concat('10.', {S('user_id % 256')}, '.9.255/12') END",
    "network_port": f"CASE {N} WHEN 0 THEN '70000' WHEN 1 THEN '-1' WHEN 2 THEN ' 443 ' WHEN 3 THEN 'http' ELSE {S('event_id')} END",
    "file_hash": f"CASE {N} WHEN 0 THEN md5({S('event_id')}) WHEN 1 THEN concat('MD5=', upper(md5({S('event_id')}))) WHEN 2 THEN concat(md5({S('event_id')}), ',', md5({S('user_id')})) WHEN 3 THEN concat(md5({S('event_id')}), md5({S('user_id')})) WHEN 4 THEN 'abc123' WHEN 5 THEN 'SHA1=zz' ELSE concat('A=', md5({S('event_id')}), '=B') END",
    "registry_key": f"CASE {N} WHEN 0 THEN concat('HKLM', chr(92), 'Software', chr(92), {S('event_id')}) WHEN 1 THEN concat('hkey_users', chr(92), 'x') WHEN 2 THEN 'NoHive' WHEN 3 THEN concat('ABC', chr(92), 'x') WHEN 4 THEN concat('HKEY_LOCAL_MACHINE', chr(92), 'System') ELSE concat(' HKCU ', chr(92), 'Run') END",
    "tag": f"CASE {N} WHEN 0 THEN concat('attack.t1', lpad({S('event_id % 1000')}, 3, '0')) WHEN 1 THEN 'T1059.001' WHEN 2 THEN 'attack.Execution' WHEN 3 THEN 'cve-2021-44228' WHEN 4 THEN 'attack.ta0002' WHEN 5 THEN 'g0016' ELSE 'custom tag' END",
    "severity": f"CASE {N} WHEN 0 THEN 'High' WHEN 1 THEN 'low' WHEN 2 THEN ' critical ' ELSE event_type END",
    "status": f"CASE {N} WHEN 0 THEN 'Stable' WHEN 1 THEN 'test' ELSE event_type END",
    "user": f"CASE {N} WHEN 0 THEN 's-1-5-18' WHEN 1 THEN 'S-1-5-21-1' WHEN 2 THEN '  ' ELSE concat('user', {S('user_id')}) END",
    "group": f"CASE {N} WHEN 0 THEN ' ' ELSE 'Admins' END",
    "dns_name": f"CASE {N} WHEN 0 THEN 'Example.COM' WHEN 1 THEN '' ELSE 'example.org' END",
    "windows_event_id": f"CASE {N} WHEN 0 THEN '46-24' WHEN 1 THEN ' 4624' ELSE {S('event_id')} END",
    "reference": f"CASE {N} WHEN 0 THEN 'https://example.org/a b' WHEN 1 THEN 'see notes' ELSE 'https://example.org/x' END",
    "process": "event_type",
    "field": f"CASE {N} WHEN 0 THEN 'Image|endswith' WHEN 1 THEN 'process.name.caseless' WHEN 2 THEN 'source' WHEN 3 THEN 'type' WHEN 4 THEN 'made.up' WHEN 5 THEN 'CommandLine|contains|all' ELSE 'user.name' END",
    "nothing": "event_type",
}
VALUE = f"CASE {K} " + " ".join(f"WHEN {i} THEN {VALUES[k]}" for i, k in enumerate(KINDS)) + " END"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{ENTITY_TYPE} AS entity_type", f"{VALUE} AS value", "'' AS source_field")


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mapped(entities(spark, sf_dir)).select("event_id", "entity_type", "mapped.*")


def case(field: str, pairs) -> str:
    return f"CASE {field} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"


def of_fields(single: bool) -> list[tuple[str, str]]:
    seen: dict[str, list[str]] = {}
    for f, c in V.categories():
        seen.setdefault(f, []).append(c)
    return [(f, c[0]) for f, c in seen.items() if (len(c) == 1) is single]


HIVE = case("lower(trim(split_part(value, chr(92), 1)))", [*V.HIVES.items(), *((v.lower(), v) for v in V.HIVES.values())])
OCT = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPNUM = "(" + " + ".join(f"split_part(split_part(trim(value), '/', 1), '.', {i + 1})::BIGINT * {256 ** (3 - i)}" for i in range(4)) + ")"
SIZE = "(1::BIGINT << (32 - split_part(trim(value), '/', 2)::INT))"
NET = "concat_ws('.', " + ", ".join(f"(({IPNUM} - {IPNUM} % {SIZE}) // {256 ** (3 - i)}) % 256" for i in range(4)) + ") || '/' || split_part(trim(value), '/', 2)"


def out(kind: str, value: str, ident: str, status: str, method: str, note: str = "NULL") -> str:
    return f"[{kind}, {value}, {ident}, '{status}', '{method}', {note}]"


def either(kind: str, canonical: str, method: str, ident: str = "NULL") -> str:
    return f"CASE WHEN {canonical} = value THEN {out(kind, 'value', ident, 'exact', 'direct_type')} ELSE {out(kind, canonical, ident, 'normalized', method)} END"


TOKEN = "CASE WHEN starts_with(lower(trim(value)), 'attack.') THEN substr(trim(value), 8) ELSE trim(value) END"
SQL_BRANCHES = {
    "process": out("'process'", "value", "NULL", "exact", "direct_type"),
    "group": f"CASE WHEN trim(value) = '' THEN {out(repr('unknown'), 'NULL', 'NULL', 'unresolved', 'none', repr('nothing is stated'))} ELSE {out(repr('group'), 'value', 'NULL', 'exact', 'direct_type')} END",
    "user": f"CASE WHEN trim(value) = '' THEN {out(repr('unknown'), 'NULL', 'NULL', 'unresolved', 'none', repr('nothing is stated'))} WHEN regexp_matches(trim(value), '(?i)^S-\\d+-\\d+(-\\d+)*$') THEN {either(repr('security_identifier'), 'upper(trim(value))', 'case_normalization', 'upper(trim(value))')} ELSE {out(repr('user_account'), 'value', 'NULL', 'exact', 'direct_type')} END",
    "dns_name": f"CASE WHEN trim(value) = '' THEN {out(repr('domain_name'), 'NULL', 'NULL', 'unresolved', 'none', repr('nothing is stated'))} ELSE {either(repr('domain_name'), 'lower(trim(value))', 'case_normalization')} END",
    "severity": f"CASE WHEN lower(trim(value)) IN {V.SEVERITIES} THEN {either(repr('severity_level'), 'lower(trim(value))', 'enum_conversion', 'lower(trim(value))')} ELSE {out(repr('severity_level'), 'NULL', 'NULL', 'unresolved', 'enum_conversion', repr('not a known severity_level'))} END",
    "status": f"CASE WHEN lower(trim(value)) IN {V.STATUSES} THEN {either(repr('rule_status'), 'lower(trim(value))', 'enum_conversion', 'lower(trim(value))')} ELSE {out(repr('rule_status'), 'NULL', 'NULL', 'unresolved', 'enum_conversion', repr('not a known rule_status'))} END",
    "windows_event_id": f"CASE WHEN regexp_matches(trim(value), '^\\d+$') THEN {out(repr('event_id'), 'value', 'trim(value)', 'exact', 'direct_type')} ELSE {out(repr('event_id'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not an event number'))} END",
    "network_port": f"CASE WHEN regexp_matches(trim(value), '^\\d+$') AND trim(value)::BIGINT <= 65535 THEN {out(repr('network_port'), 'value', 'trim(value)', 'exact', 'direct_type')} ELSE {out(repr('network_port'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not a port from 0 to 65535'))} END",
    "reference": f"CASE WHEN regexp_matches(trim(value), '^[A-Za-z][A-Za-z0-9+.-]*://\\S+$') THEN {out(repr('reference_url'), 'value', 'NULL', 'exact', 'direct_type')} ELSE {out(repr('unknown'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not a URL'))} END",
    "file_hash": f"""CASE WHEN length(value) - length(replace(value, '=', '')) > 1 OR contains(value, ',') THEN {out(repr('file_hash'), 'NULL', 'NULL', 'unresolved', 'ambiguous', repr('several digests, so none is taken'))}
        WHEN regexp_matches(value, '^\\s*[A-Za-z0-9_]+\\s*=\\s*[A-Fa-f0-9]+\\s*$') THEN {out(repr('file_hash'), "lower(trim(split_part(value, '=', 2)))", 'NULL', 'normalized', 'value_split')}
        WHEN regexp_matches(value, '^\\s*[A-Fa-f0-9]+\\s*$') AND length(trim(value)) IN (32, 40, 64) THEN {out(repr('file_hash'), 'lower(trim(value))', 'NULL', 'normalized', 'syntax_pattern')}
        WHEN regexp_matches(value, '^\\s*[A-Fa-f0-9]+\\s*$') THEN {out(repr('file_hash'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('no algorithm has digests of this length'))}
        ELSE {out(repr('file_hash'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not a hash digest'))} END""",
    "registry_key": f"""CASE WHEN NOT contains(value, chr(92)) THEN {out(repr('registry_key'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('no hive before the first backslash'))}
        WHEN {HIVE} IS NULL THEN {out(repr('registry_key'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not the name of a hive'))}
        WHEN {HIVE} = split_part(value, chr(92), 1) THEN {out(repr('registry_key'), 'value', 'NULL', 'exact', 'direct_type')}
        ELSE {out(repr('registry_key'), f"{HIVE} || substr(value, length(split_part(value, chr(92), 1)) + 1)", 'NULL', 'normalized', 'alias_table')} END""",
    "tag": f"CASE WHEN regexp_matches({TOKEN}, '(?i)^T[0-9]{{4}}(\\.[0-9]{{3}})?$') THEN {either(repr('attack_technique_reference'), f'upper({TOKEN})', 'syntax_pattern', f'upper({TOKEN})')} "
    + " ".join(f"WHEN regexp_matches({TOKEN}, '(?i)^{p}$') THEN {either(repr(k), f'upper({TOKEN})', 'syntax_pattern', f'upper({TOKEN})')}" for k, p in (("attack_tactic_reference", "TA[0-9]{4}"), ("attack_group_reference", "G[0-9]{4}"), ("attack_software_reference", "S[0-9]{4}"), ("cve_reference", "CVE-[0-9]{4}-[0-9]{4,}")))
    + f" WHEN starts_with(lower(trim(value)), 'attack.') AND {TOKEN} <> '' THEN {out(repr('attack_tactic_reference'), f'lower({TOKEN})', 'NULL', 'normalized', 'syntax_pattern')} ELSE {out(repr('rule_tag'), 'value', 'NULL', 'exact', 'direct_type')} END",
    "field": f"""CASE WHEN lower(regexp_replace(split_part(value, '|', 1), '(?i)(.)\\.caseless$', '\\1')) IN ('source', 'type', 'service') THEN {out(repr('unknown_field'), 'NULL', 'NULL', 'unresolved', 'ambiguous', repr('a field of several categories'))}
        WHEN {case("lower(regexp_replace(split_part(value, '|', 1), '(?i)(.)[.]caseless$', chr(92) || '1'))", of_fields(True))} IS NULL THEN {out(repr('unknown_field'), 'NULL', 'NULL', 'unresolved', 'alias_table', repr('not a known field'))}
        ELSE {out(case("lower(regexp_replace(split_part(value, '|', 1), '(?i)(.)[.]caseless$', chr(92) || '1'))", of_fields(True)), "regexp_replace(split_part(value, '|', 1), '(?i)(.)[.]caseless$', chr(92) || '1')", 'NULL', 'alias', 'alias_table')} END""",
    "nothing": out("'unknown'", "NULL", "NULL", "unresolved", "none", "'a type without a canonical form'"),
    "ip_address": f"CASE WHEN regexp_matches(trim(value), '^{OCT}(\\.{OCT}){{3}}$') THEN {out(repr('ip_address'), 'value', 'trim(value)', 'exact', 'direct_type')} WHEN regexp_matches(trim(value), '^{OCT}(\\.{OCT}){{3}}/(3[0-2]|[12]?[0-9])$') THEN {out(repr('ip_network'), NET, NET, 'normalized', 'syntax_pattern')} ELSE {out(repr('ip_address'), 'NULL', 'NULL', 'unresolved', 'syntax_pattern', repr('not an address or a network'))} END",
}
NAMES = ("canonical_type", "canonical_value", "canonical_id", "status", "method", "note")
SQL_ENTITIES = f"SELECT event_id, {ENTITY_TYPE} AS entity_type, {VALUE} AS value FROM events"
CANONICAL_FORMS = f"""WITH e AS ({SQL_ENTITIES}), m AS (SELECT event_id, entity_type, CASE entity_type {" ".join(f"WHEN '{k}' THEN {b}" for k, b in SQL_BRANCHES.items())} END AS m FROM e)
SELECT event_id, entity_type, {", ".join(f"m[{i + 1}] AS {n}" for i, n in enumerate(NAMES))} FROM m"""


def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.mapped(entities(spark, sf_dir))
    return rows.groupBy("entity_type", F.col("mapped.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapped.method") == "ambiguous").alias("ambiguous"), F.countDistinct("mapped.canonical_id").alias("ids"))


MAPPING_COUNTS = f"WITH c AS ({CANONICAL_FORMS}) SELECT entity_type, status, count(*) AS n, count_if(method = 'ambiguous')::BIGINT AS ambiguous, count(DISTINCT canonical_id) AS ids FROM c GROUP BY ALL"

def mapping_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.detailed(M.mapped(entities(spark, sf_dir)))
    return rows.select("event_id", "entity_type", "confidence", F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"))


MAPPING_DETAILS = f"""WITH c AS ({CANONICAL_FORMS}), v AS (SELECT c.*, e.value FROM c JOIN ({SQL_ENTITIES}) e USING (event_id)), d AS (SELECT *, status <> 'unresolved' AS done, regexp_extract(value, '^\\s*([A-Za-z0-9_]+)\\s*=', 1) AS label FROM v)
SELECT event_id, entity_type, CASE WHEN done THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN entity_type = 'field' THEN 'canonical_field=' || regexp_replace(split_part(value, '|', 1), '(?i)(.)[.]caseless$', chr(92) || '1')
WHEN NOT done THEN '' WHEN canonical_type = 'file_hash' THEN 'algorithm=' || CASE WHEN label <> '' THEN lower(label) ELSE CASE length(canonical_value) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' ELSE 'sha256' END END
WHEN canonical_type = 'ip_address' THEN 'version=4' WHEN canonical_type = 'ip_network' THEN 'prefix_length=' || split_part(canonical_id, '/', 2) || ';version=4' WHEN canonical_type = 'attack_tactic_reference' AND canonical_id IS NULL THEN 'tactic=' || canonical_value
WHEN canonical_type = 'registry_key' THEN 'hive=' || split_part(canonical_value, chr(92), 1) WHEN canonical_type = 'event_id' THEN 'event_id=' || trim(value) ELSE '' END AS attributes FROM d"""

FIELDS = ("process.name", "CommandLine|contains", "user", "made.up", "source", "file.path.caseless")
QUERY = f"""CASE event_id % 6 WHEN 0 THEN concat('process.name:(a or b or "c d") and user.name : ', {S('user_id')})
 WHEN 1 THEN concat('not event.code == "', event_type, '" or x != (', {S('event_id')}, ')') WHEN 2 THEN 'file.path:"unterminated and y:z' WHEN 3 THEN concat('host.ip: not ', {S('user_id')}, ' or and:x')
 WHEN 4 THEN concat('a.b:*', event_type, '*) c:()') ELSE 'no pairs here' END"""


def query_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{QUERY} AS query")
    return E.query_pairs(rows).select("event_id", "n", "field", "value", "location")


QUERY_PAIRS = f"""WITH q AS (SELECT event_id, user_id, event_type, {QUERY} AS query FROM events), p AS (
SELECT event_id, CASE event_id % 6
 WHEN 0 THEN [['process.name', 'a', '0', ''], ['process.name', 'b', '0', '[1]'], ['process.name', 'c d', '0', '[2]'], ['user.name', user_id::VARCHAR, (instr(query, 'user.name') - 1)::VARCHAR, '']]
 WHEN 1 THEN [['event.code', event_type, '4', ''], ['x', event_id::VARCHAR, instr(query, ' x !=')::VARCHAR, '']]
 WHEN 2 THEN [['y', 'z', (instr(query, 'y:z') - 1)::VARCHAR, '']]
 WHEN 3 THEN [['host.ip', user_id::VARCHAR, '0', '']]
 WHEN 4 THEN [['a.b', '*' || event_type || '*', '0', '']]
 END AS rows FROM q), u AS (SELECT event_id, unnest(rows) AS r, generate_subscripts(rows, 1) - 1 AS n FROM p)
SELECT event_id, n::INT AS n, r[1] AS field, r[2] AS value, 'detection.query[' || r[3] || ']' || r[4] AS location FROM u"""


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, put into a detection block with a list and a null."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"selection": {"Type|re": ["'), "event_type", F.lit('", 7, true, null], "deep": {"z": '), F.col("user_id").cast("string"), F.lit(', "a": null}}, "filter": "x"}')).alias("detection"))
    return E.nested_values(rows).select("event_id", "n", "field", "value", "location")


NESTED_VALUES = """SELECT event_id, n, field, value, location FROM (
SELECT event_id, 0::INT AS n, 'Type|re' AS field, event_type AS value, 'detection.selection.Type|re[0]' AS location FROM events
UNION ALL SELECT event_id, 1, 'Type|re', '7', 'detection.selection.Type|re[1]' FROM events
UNION ALL SELECT event_id, 2, 'z', user_id::VARCHAR, 'detection.selection.deep.z' FROM events
UNION ALL SELECT event_id, 3, 'filter', 'x', 'detection.filter' FROM events)"""

FIELD = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS)) + " END"


def route_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{FIELD} AS field", "event_type AS value")
    return E.routed(rows).select("event_id", "field", "value", "extractor", "entity_type")


ROUTE_FIELDS = f"""WITH routes(route, extractor, entity_type) AS (VALUES {", ".join(f"('{f}', '{e}', '{t}')" for f, e, t in V.routes())})
SELECT event_id, field, value, extractor, entity_type FROM (SELECT event_id, {FIELD} AS field, event_type AS value FROM events) e
JOIN routes ON route = lower(trim(regexp_replace(split_part(field, '|', 1), '(?i)(.)[.]caseless$', chr(92) || '1')))"""


def shape_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("scope"), "text")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("scope"), F.col("url").alias("text"))
    return E.shapes(docs.unionByName(pages), kinds=("url", "ip_address", "file_hash")).select("scope", "entity_type", "extractor", "n", "value")


def scan_sql(kind: str) -> str:
    extractor, pattern = E.SHAPES[kind]
    p = pattern.replace("'", "''")
    return f"SELECT scope, '{kind}' AS entity_type, '{extractor}' AS extractor, (generate_subscripts(regexp_extract_all(text, '{p}'), 1) - 1)::INT AS n, unnest(regexp_extract_all(text, '{p}')) AS value FROM s"


SHAPE_SCAN = "WITH s AS (SELECT 'd' || doc_id AS scope, text FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages) " + " UNION ALL ".join(map(scan_sql, ("url", "ip_address", "file_hash")))

QUERIES = {
    "canonical_forms": (canonical_forms, CANONICAL_FORMS),
    "mapping_counts": (mapping_counts, MAPPING_COUNTS),
    "mapping_details": (mapping_details, MAPPING_DETAILS),
    "query_pairs": (query_pairs, QUERY_PAIRS),
    "nested_values": (nested_values, NESTED_VALUES),
    "route_fields": (route_fields, ROUTE_FIELDS),
    "shape_scan": (shape_scan, SHAPE_SCAN),
}
