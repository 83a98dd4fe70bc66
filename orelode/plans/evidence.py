"""Queries over ranked evidence, packages, checks, documents and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators import checks as K
from orelode.operators import context as C
from orelode.operators import evaluation as V
from orelode.operators import ranking as R
from orelode.operators import rule_parsing as P
from orelode.operators import vocabulary as W
from orelode.operators.chunks import DEFAULT_SECTION
from orelode.session import table

SOURCES = list(DEFAULT_SECTION)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks and their customers' nations as queries; lines are the text route, priorities the graph."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    key = F.concat(F.lit("chunk"), F.col("o_orderkey").cast("string"))
    rows = o.select(F.col("c_nationkey").alias("query_id"), key.alias("chunk_id"), "o_orderkey", "o_totalprice", "o_orderpriority")
    none = F.array().cast("array<string>")
    text = rows.filter("o_orderkey % 3 <> 0 OR o_orderkey % 2 <> 0").withColumn("evidence", R.evidence("text", F.when(F.col("o_orderkey") % 5 == 0, "exact_identifier").otherwise("lexical"), F.floor(F.col("o_totalprice") / 10000), F.lit(None), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.concat(F.lit("Q"), F.col("query_id").cast("string")))).otherwise(none)))
    graph = rows.filter("o_orderkey % 2 = 0").withColumn("evidence", R.evidence("graph", R.match_kind(F.col("o_orderkey") % 3, F.lit("Q1"), F.array(F.lit("q1"))), 1.0 / (1 + F.col("o_orderkey") % 3), F.col("o_orderkey") % 3, F.array(F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")))))
    out = R.merged(text, graph)
    n = F.substring("chunk_id", 6, 20).cast("long")
    fields = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("F2"), F.lit("f1"))).otherwise(none)
    out = out.withColumns({"source": F.element_at(F.array(*map(F.lit, SOURCES)), (n % 5 + 1).cast("int")), "section": F.element_at(F.array(*map(F.lit, W.SECTION_WEIGHTS)), (n % 15 + 1).cast("int")), "identifiers": F.array(F.concat(F.lit("q"), F.col("query_id").cast("string"))), "fields": fields})
    place = F.array_min(F.filter(F.transform(F.flatten(F.transform("evidence", lambda e: e.matched)), lambda m: F.array_position(F.transform("fields", lambda f: F.lower(f)), F.lower(m))), lambda p: p > 0))
    return out.withColumn("named_at", place)


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.ranked(R.scored(candidates(spark, sf_dir)), 20, 60)
    return out.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "total", F.col("score_exact").alias("exact"), F.col("score_entity").alias("entity"), F.round("score_lexical", 6).alias("lexical"), F.round("score_distance", 6).alias("distance"))


CANDIDATES = f"""o AS (SELECT c_nationkey AS query_id, 'chunk' || o_orderkey AS chunk_id, o_orderkey AS k, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, (k % 3 <> 0 OR k % 2 <> 0) AS by_text, k % 2 = 0 AS by_graph, query_id % 2 = 0 AS has_fields, {SOURCES}[k % 5 + 1] AS source, {list(W.SECTION_WEIGHTS.values())}[k % 15 + 1]::DOUBLE AS section,
    ((k % 3 <> 0 OR k % 2 <> 0) AND k % 5 = 0)::INT::DOUBLE AS exact_text FROM o),
parts AS (SELECT *, CASE WHEN exact_text = 1 OR (by_graph AND k % 3 = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS exact,
    CASE WHEN exact_text = 1 OR (by_graph AND has_fields AND k % 4 IN (1, 2)) THEN 1.0 ELSE 0.0 END::DOUBLE AS entity, by_graph::INT::DOUBLE AS graph,
    CASE WHEN by_text AND floor(o_totalprice / 10000) > 0 THEN floor(o_totalprice / 10000) / (floor(o_totalprice / 10000) + 12.0::DOUBLE) ELSE 0 END::DOUBLE AS lexical,
    CASE WHEN by_graph THEN pow(0.6::DOUBLE, (k % 3)::DOUBLE) ELSE 0 END AS distance,
    CASE WHEN source = 'ecs' AND has_fields THEN 1.0 ELSE {[W.SOURCE_WEIGHTS[s] for s in SOURCES]}[k % 5 + 1] END::DOUBLE AS weight,
    CASE WHEN has_fields AND by_graph AND k % 4 = 2 THEN 1 WHEN has_fields AND by_graph AND k % 4 = 1 THEN 2 END AS named_at FROM c),
scored AS (SELECT *, round(0.3::DOUBLE * exact + 0.2::DOUBLE * entity + 0.2::DOUBLE * graph + 0.15::DOUBLE * lexical + 0.07::DOUBLE * weight + 0.05::DOUBLE * distance + 0.03::DOUBLE * section, 6) AS total FROM parts),
slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, chunk_id) AS slot FROM scored) WHERE slot <= 60),
tied AS (SELECT *, row_number() OVER (PARTITION BY query_id, total, source = 'ecs' ORDER BY slot) AS place, row_number() OVER (PARTITION BY query_id, total, source = 'ecs' ORDER BY coalesce(named_at, 1 << 30), chunk_id) AS member FROM slots),
ranked AS (SELECT t.*, CASE WHEN t.source = 'ecs' AND t.has_fields THEN s.slot ELSE t.slot END AS rank FROM tied t LEFT JOIN tied s ON s.query_id = t.query_id AND s.total = t.total AND s.source = 'ecs' AND t.source = 'ecs' AND s.place = t.member)"""
HYBRID_RANK = f"WITH {CANDIDATES} SELECT query_id, chunk_id, rank::INT AS rank, total, exact, entity, round(lexical, 6) AS lexical, round(distance, 6) AS distance FROM ranked WHERE rank <= 20"


def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.statistics(candidates(spark, sf_dir))


RETRIEVAL_STATS = f"WITH {CANDIDATES} SELECT query_id, count(*) AS candidates, count_if(by_text)::BIGINT AS by_text, count_if(by_graph)::BIGINT AS by_graph, count_if(by_text AND by_graph)::BIGINT AS by_both, max(CASE WHEN by_graph THEN k % 3 ELSE 0 END)::INT AS max_hops FROM c GROUP BY query_id"


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.ablations(R.scored(candidates(spark, sf_dir)))
    return rows.groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("n"), F.max("variant_total").alias("best"), F.round(F.avg("variant_total"), 5).alias("mean"))


VARIANTS = {"full": None, "lexical": "0.15::DOUBLE * lexical", "graph": "0.2::DOUBLE * graph", "distance": "0.05::DOUBLE * distance", "source": "0.07::DOUBLE * weight", "section": "0.03::DOUBLE * section"}
TERMS = ("0.3::DOUBLE * exact", "0.2::DOUBLE * entity", "0.2::DOUBLE * graph", "0.15::DOUBLE * lexical", "0.07::DOUBLE * weight", "0.05::DOUBLE * distance", "0.03::DOUBLE * section")
ABLATION = f"WITH {CANDIDATES} SELECT query_id, variant, count(*) AS n, max(t) AS best, round(avg(t), 5) AS mean FROM (" + " UNION ALL ".join(f"SELECT query_id, '{v}' AS variant, round({' + '.join(t for t in TERMS if t != gone)}, 6) AS t FROM parts" for v, gone in VARIANTS.items()) + ") GROUP BY ALL"


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.md5(F.encode("redacted", "UTF-8")).alias("digest"), F.array_join("fired", ",").alias("fired"))


CRED = {n: p.replace("'", "''") for n, p, _ in C.CREDENTIALS}
REDACT = f"""WITH a AS (SELECT doc_id, text, regexp_matches(text, '{CRED["assignment"]}') AS f1, regexp_replace(text, '{CRED["assignment"]}', '\\1=[REDACTED]', 'g') AS t1 FROM documents),
b AS (SELECT *, regexp_matches(t1, '{CRED["aws_access_key"]}') AS f2, regexp_replace(t1, '{CRED["aws_access_key"]}', '[REDACTED]', 'g') AS t2 FROM a),
c AS (SELECT *, regexp_matches(t2, '{CRED["private_key_block"]}') AS f3, regexp_replace(t2, '{CRED["private_key_block"]}', '[REDACTED]', 'g') AS t3 FROM b),
d AS (SELECT *, regexp_matches(t3, '{CRED["google_api_key"]}') AS f4, regexp_replace(t3, '{CRED["google_api_key"]}', '[REDACTED]', 'g') AS t4 FROM c)
SELECT doc_id, md5(t4) AS digest, concat_ws(',', CASE WHEN f1 THEN 'assignment' END, CASE WHEN f2 THEN 'aws_access_key' END, CASE WHEN f3 THEN 'private_key_block' END, CASE WHEN f4 THEN 'google_api_key' END) AS fired FROM d"""

ITEM = """SELECT concat('p', CAST(doc_id % 23 AS STRING)) AS package_id, concat('i', CAST(doc_id AS STRING)) AS item_id, CASE doc_id % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'rule' WHEN 2 THEN 'retrieval' ELSE 'entities' END AS section,
CAST(doc_id AS BIGINT) AS ordinal, CAST(doc_id % 3 AS INT) AS priority, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id % 40 AS INT) END AS rank, CAST(n_chars AS DOUBLE) AS score, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id % 2 AS INT) END AS hops, text FROM documents"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return C.organised(spark.sql(ITEM))


def organised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("package_id", "item_id", "section", F.col("place").cast("int").alias("place"))


ORGANISED = f"""items AS ({ITEM}), organised AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY list_position({list(C.SECTIONS)}, section), CASE WHEN section IN ('retrieval', 'graph') THEN priority END, CASE WHEN section IN ('retrieval', 'graph') THEN coalesce(rank, 1 << 30) END,
    CASE WHEN section IN ('retrieval', 'graph') THEN -score END, CASE WHEN section IN ('retrieval', 'graph') THEN coalesce(hops, 1 << 30) END, CASE WHEN section IN ('retrieval', 'graph') THEN 0 ELSE ordinal END, item_id) AS place FROM items)"""


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.budgeted(items(spark, sf_dir)).select("package_id", "item_id", F.col("place").cast("int").alias("place"), "size", "kept")


def fold(name: str, rows: str, group: str, size: str, limit: int) -> str:
    """A recursive fold of items under a limit, in order of place; groups within it stay."""
    return f"""{name}_in AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY place) AS n, sum({size}) OVER (PARTITION BY {group}) AS total FROM {rows}),
{name}_run AS (SELECT {group}, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS kept, ''::VARCHAR AS item_id FROM {name}_in WHERE n = 1
    UNION ALL SELECT i.{group.replace(", ", ", i.")}, i.n, r.used + k, k, i.item_id FROM {name}_run r JOIN {name}_in i ON {" AND ".join(f"i.{g} = r.{g}" for g in group.split(", "))} AND i.n = r.n + 1,
    LATERAL (SELECT CASE WHEN i.total <= {limit} THEN i.{size} WHEN {limit} - r.used <= 0 THEN 0 WHEN i.{size} <= {limit} - r.used THEN i.{size} WHEN {limit} - r.used > 15 THEN {limit} - r.used ELSE 0 END::BIGINT AS k)),
{name} AS (SELECT i.package_id, i.item_id, i.section, i.place, i.size, r.kept FROM {name}_in i JOIN {name}_run r ON r.item_id = i.item_id AND r.n = i.n AND r.package_id = i.package_id)"""


CONTEXT_BUDGET = f"""WITH RECURSIVE {ORGANISED}, sized AS (SELECT package_id, item_id, section, place, length(text)::BIGINT AS size, length(text)::BIGINT AS kept FROM organised),
{fold("first", "sized", "package_id, section", "kept", C.SECTION_LIMIT)},
{fold("second", "first", "package_id", "kept", C.TOTAL_LIMIT - C.RESERVED)}
SELECT package_id, item_id, place::INT AS place, size, kept FROM second"""


def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    kept = C.budgeted(rows).select("package_id", "item_id", "size", "kept")
    cut = rows.join(kept, ["package_id", "item_id"]).withColumn("text", C.cut_text(F.col("text"), F.col("size"), F.col("kept")))
    out = C.section_texts(cut)
    return out.select("package_id", "section", "items", F.md5(F.encode("text", "UTF-8")).alias("digest"))


SECTION_TEXTS = CONTEXT_BUDGET.replace("SELECT package_id, item_id, place::INT AS place, size, kept FROM second", """, texts AS (SELECT s.package_id, s.section, s.place, CASE WHEN s.kept = s.size THEN o.text WHEN s.kept > 15 THEN substr(o.text, 1, s.kept - 15) || chr(10) || '[...truncated]' END AS text FROM second s JOIN organised o USING (package_id, item_id))
SELECT package_id, section, count(*) AS items, md5(string_agg(text, chr(10) || chr(10) ORDER BY place)) AS digest FROM texts WHERE text IS NOT NULL GROUP BY ALL""")


def warning_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings up to the ceiling, and the notice that counts the others; lines as warnings, for they are many and short."""
    return C.within_ceiling(warnings(spark, sf_dir)).select("package_id", "ordinal", "text")


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("CAST(doc_id % 20 AS BIGINT) AS package_id", "CAST(doc_id AS BIGINT) AS ordinal", "text")


WARNING_CEILING = """WITH w AS (SELECT doc_id % 20 AS package_id, doc_id AS ordinal, text, count(*) OVER (PARTITION BY doc_id % 20) AS n FROM documents),
r AS (SELECT *, sum(length(text)) OVER (PARTITION BY package_id ORDER BY ordinal) <= 20000 - length(n || ' more warning(s) came up and are left out: this section holds 20000 characters at most') AS fits FROM w),
k AS (SELECT package_id, ordinal, text, n FROM r WHERE fits)
SELECT package_id, ordinal, text FROM k
UNION ALL SELECT w.package_id, max(w.ordinal) + 1, (any_value(w.n) - (SELECT count(*) FROM k WHERE k.package_id = w.package_id)) || ' more warning(s) came up and are left out: this section holds 20000 characters at most'
FROM w GROUP BY w.package_id HAVING any_value(w.n) > (SELECT count(*) FROM k WHERE k.package_id = w.package_id)"""


def dropped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.budgeted(items(spark, sf_dir)).filter("kept = 0").withColumns({"detail": F.lit("no budget remained for this item"), "ordinal": F.col("place").cast("int")})
    return C.collapsed(rows).select("package_id", "section", "detail", "ordinal", "item_id", "n")


DROPPED = CONTEXT_BUDGET.replace("SELECT package_id, item_id, place::INT AS place, size, kept FROM second", "SELECT package_id, section, 'no budget remained for this item' AS detail, min(place)::INT AS ordinal, arg_min(item_id, place) AS item_id, count(*) AS n FROM second WHERE kept = 0 GROUP BY ALL")


def package_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with items that are said to be cut, share an id, or a place: these stay in the order that they had."""
    rows = items(spark, sf_dir).withColumns({"first_place": F.col("place"), "truncated": F.col("ordinal") % 11 == 0, "item_id": F.when(F.col("ordinal") % 13 == 0, "same").otherwise(F.col("item_id")), "place": F.when(F.col("ordinal") % 50 == 0, F.lit(0)).otherwise(F.col("place")) * 1000 + F.col("ordinal") % 1000})
    return C.problems(rows, order=("place", "first_place"))


PACKAGE_VALIDATE = f"""WITH {ORGANISED}, rows AS (SELECT package_id, section, list_position({list(C.SECTIONS)}, section) AS so, CASE WHEN ordinal % 13 = 0 THEN 'same' ELSE item_id END AS item_id, ordinal % 11 = 0 AS truncated, CASE WHEN ordinal % 50 = 0 THEN 0 ELSE place END * 1000 + ordinal % 1000 AS place, text FROM organised),
l AS (SELECT *, lag(so) OVER (PARTITION BY package_id ORDER BY place) AS before FROM rows)
SELECT 'section_over_budget' AS code, package_id, section AS subject FROM rows GROUP BY ALL HAVING sum(length(text)) > 20000 UNION ALL SELECT 'over_budget', package_id, '' FROM rows GROUP BY package_id HAVING sum(length(text)) > 52000
UNION ALL SELECT 'duplicate_item', package_id, item_id FROM rows GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'section_order', package_id, item_id FROM l WHERE before > so
UNION ALL SELECT 'no_mark', package_id, item_id FROM rows WHERE truncated AND NOT ends_with(text, chr(10) || '[...truncated]') UNION ALL SELECT 'secret', package_id, item_id FROM rows WHERE {" OR ".join(f"regexp_matches(text, '{p}')" for p in CRED.values())}"""


def identifier_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat('x T1059.001, T', CAST(event_id % 97 AS STRING), CASE event_id % 5 WHEN 0 THEN '.' WHEN 1 THEN '.5' WHEN 2 THEN '-a' WHEN 3 THEN ' end' ELSE ')' END)"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"{made} AS text", "CASE event_id % 4 WHEN 0 THEN 'T1059' WHEN 1 THEN 'T1059.001' ELSE concat('T', CAST(event_id % 97 AS STRING)) END AS identifier")
    return rows.select("event_id", K.occurs(F.col("identifier"), F.col("text")).alias("occurs"))


IDENTIFIER = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE event_id % 5 IN (0, 3, 4) END AS occurs FROM events"""


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS rule_id", "CASE p_partkey % 3 WHEN 0 THEN 'eql' WHEN 1 THEN 'query' ELSE 'esql' END AS type", "CASE p_partkey % 4 WHEN 0 THEN 'eql' WHEN 1 THEN 'kql' ELSE 'esql' END AS language",
        "CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity", "CAST(p_partkey * 7 % 120 AS INT) AS risk_score",
        "CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat('a:( ', p_brand, ' )  and b') ELSE p_name END AS query", "CASE WHEN p_partkey % 6 < 3 THEN concat('a:(', p_brand, ') and b') ELSE p_type END AS original",
    )


def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rule_issues(rule_rows(spark, sf_dir))


RULE_ROWS = "r AS (SELECT p_partkey AS rule_id, CASE p_partkey % 3 WHEN 0 THEN 'eql' WHEN 1 THEN 'query' ELSE 'esql' END AS type, CASE p_partkey % 4 WHEN 0 THEN 'eql' WHEN 1 THEN 'kql' ELSE 'esql' END AS language, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, (p_partkey * 7 % 120)::INT AS risk_score, CASE p_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN concat('a:( ', p_brand, ' )  and b') ELSE p_name END AS query, CASE WHEN p_partkey % 6 < 3 THEN concat('a:(', p_brand, ') and b') ELSE p_type END AS original FROM part)"
RULE_VALIDATE = f"""WITH {RULE_ROWS}, issues AS (
SELECT rule_id, 'language_mismatch' AS code, 'error' AS severity, 'rule' AS path, type || '/' || language AS message FROM r WHERE NOT (type = 'query' AND language IN ('kql', 'lucene') OR type <> 'query' AND type = language)
UNION ALL SELECT rule_id, 'risk_outside_band', 'warning', 'rule', severity || '/' || risk_score FROM r WHERE risk_score NOT BETWEEN CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 22 WHEN 'high' THEN 48 ELSE 74 END AND CASE severity WHEN 'low' THEN 21 WHEN 'medium' THEN 47 WHEN 'high' THEN 73 ELSE 100 END
UNION ALL SELECT rule_id, 'out_of_range', 'error', 'rule', risk_score::VARCHAR FROM r WHERE risk_score NOT BETWEEN 0 AND 100
UNION ALL SELECT rule_id, 'missing_text', 'error', 'rule', 'query' FROM r WHERE trim(query) = ''
UNION ALL SELECT rule_id, 'rule_unchanged', 'error', 'rule', 'query' FROM r WHERE rule_id % 6 = 1)
"""


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reported(K.rule_issues(rule_rows(spark, sf_dir)))


VALIDATION_REPORT = f"{RULE_VALIDATE} SELECT rule_id, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings, string_agg(path || ':' || code || ':' || message, ';' ORDER BY path || ':' || code || ':' || message) AS listing, count_if(severity = 'error') = 0 AS valid FROM issues GROUP BY rule_id"


def ledger_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    both = o.select(F.concat(F.lit("k"), (F.col("o_orderkey") % 400).cast("string")).alias("package_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").cast("string").alias("identifier"), F.when(F.col("o_orderstatus") == "O", "unresolved").when(F.col("o_orderstatus") == "F", "ambiguous").otherwise("redirected").alias("status"))
    supplied = K.ledger(both).withColumn("candidates", F.when(F.col("ordinal") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    told = supplied.filter("ordinal % 5 <> 0").select("package_id", "identifier", F.when(F.col("ordinal") % 7 == 0, "resolved").otherwise(F.col("status")).alias("status"), F.when(F.col("ordinal") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("candidates"))
    invented = table(spark, sf_dir, "nation").select(F.lit("k1").alias("package_id"), F.col("n_name").alias("identifier"), F.lit("unresolved").alias("status"), F.array(F.lit("a")).alias("candidates"))
    return K.ledger_issues(supplied, told.unionByName(invented))


LEDGER = """WITH b AS (SELECT 'k' || (o_orderkey % 400) AS package_id, o_orderkey AS ordinal, o_custkey::VARCHAR AS identifier, CASE o_orderstatus WHEN 'O' THEN 'unresolved' WHEN 'F' THEN 'ambiguous' END AS status FROM orders),
s AS (SELECT package_id, identifier, arg_min(status, ordinal) AS status, min(ordinal) AS ordinal FROM b WHERE status IS NOT NULL GROUP BY ALL)
SELECT package_id, identifier, CASE WHEN ordinal % 5 = 0 THEN 'dropped' WHEN ordinal % 7 = 0 THEN 'changed' WHEN ordinal % 2 = 0 AND ordinal % 3 = 0 THEN 'narrowed' ELSE 'widened' END AS code FROM s WHERE ordinal % 5 = 0 OR ordinal % 7 = 0 OR (ordinal % 2 = 0 AND ordinal % 3 = 0) OR (ordinal % 2 = 1 AND ordinal % 3 <> 0)
UNION ALL SELECT 'k1', n_name, 'invented' FROM nation"""


def fabricated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    supplied = c.filter("turn % 2 = 0").select(F.col("conv_id").alias("reply_id"), F.col("turn").cast("string").alias("item_id"), "text")
    claimed = c.filter("turn % 2 = 1").select(F.col("conv_id").alias("reply_id"), F.concat(F.lit("turn."), F.col("turn").cast("string")).alias("path"), F.regexp_extract("text", "([A-Za-z0-9]+)", 1).alias("identifier"))
    return K.fabricated(claimed, supplied)


FABRICATED = r"""WITH s AS (SELECT conv_id AS reply_id, text FROM conversations WHERE turn % 2 = 0), c AS (SELECT conv_id AS reply_id, 'turn.' || turn AS path, regexp_extract(text, '([A-Za-z0-9]+)', 1) AS identifier FROM conversations WHERE turn % 2 = 1)
SELECT reply_id, path, identifier FROM c WHERE identifier = '' OR NOT EXISTS (SELECT 1 FROM s WHERE s.reply_id = c.reply_id AND regexp_matches(s.text, '(^|[^A-Za-z0-9_.\-])' || identifier || '($|[^A-Za-z0-9_.\-]|\.($|[^A-Za-z0-9_]))'))"""


def rating_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", K.rating((F.col("p_partkey") * 13 % 101).cast("int")).alias("rating"), K.looked_up(K.PRIORITY, F.element_at(F.array(*map(F.lit, K.PRIORITY)), (F.col("p_size") % 4 + 1).cast("int"))).alias("priority"), K.change_label(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")), F.when(F.col("p_size") % 3 == 1, " ").otherwise(F.col("p_type"))).alias("label"))


RATING = """SELECT p_partkey, CASE WHEN p_partkey * 13 % 101 >= 95 THEN 'A+' WHEN p_partkey * 13 % 101 >= 85 THEN 'A' WHEN p_partkey * 13 % 101 >= 70 THEN 'B' WHEN p_partkey * 13 % 101 >= 50 THEN 'C' WHEN p_partkey * 13 % 101 >= 30 THEN 'D' ELSE 'F' END AS rating, (p_size % 4 + 1)::INT AS priority,
CASE p_size % 3 WHEN 0 THEN 'Added ' || p_type WHEN 1 THEN 'Removed ' || p_brand ELSE 'Changed ' || p_brand || ' to ' || p_type END AS label FROM part"""


def format_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    doc = K.mapping_document(F.lit("TA0002"), F.concat(F.lit("T"), F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 2 == 0, "T1").otherwise(" "), (F.col("p_partkey") % 8) / 8.0)
    return p.select("p_partkey", doc.alias("document"))


FORMAT_JSON = """SELECT p_partkey, '{"tacticId":"TA0002","techniqueId":' || CASE WHEN p_partkey % 2 = 0 THEN '"T1"' ELSE '"T' || p_size || '"' END || ',"subTechniqueId":' || CASE WHEN p_partkey % 2 = 0 THEN '"T' || p_size || '"' ELSE 'null' END || ',"confidence":' || [0, 12, 25, 38, 50, 62, 75, 88][p_partkey % 8 + 1] || '}' AS document FROM part"""

DOC = """CASE p_partkey % 7 WHEN 0 THEN concat('{"title": "', p_name, '", "id": "', CAST(p_partkey AS STRING), '", "level": "HIGH", "status": "testing", "tags": ["a", 5, "b"], "detection": {"s": 1, "condition": "s"}}')
WHEN 1 THEN concat('{"name": "', p_name, '", "rule_id": "', CAST(p_partkey AS STRING), '", "query": "q", "type": "query", "language": "KQL", "risk_score": "', CAST(p_size AS STRING), '", "severity": "info", "tags": "one", "threat": [{"technique": [{"id": "T1", "subtechnique": [{"id": "T1.1"}]}, {"id": "T2"}]}, {"technique": [{"id": "T1"}]}]}')
WHEN 2 THEN concat('{"name": 7, "id": "x", "type": "eql", "risk_score": true, "language": "odd"}') WHEN 3 THEN '{"detection": {"condition": "c"}}' WHEN 4 THEN '[1, 2]' WHEN 5 THEN '{"title": "t", "detection": {}}' ELSE '{broken' END"""


def parsed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.parsed(table(spark, sf_dir, "part").selectExpr("p_partkey AS rule_id", f"{DOC} AS text"))
    return rows.select("rule_id", "format", "identifier", "title", "severity", "status", "language", "risk_score", "query", F.array_join("tags", ",").alias("tags"), "fault")


PARSED_RULES = """SELECT p_partkey AS rule_id, ['sigma', 'elastic', 'elastic', 'sigma', 'invalid', 'sigma', 'invalid'][p_partkey % 7 + 1] AS format, CASE p_partkey % 7 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey::VARCHAR WHEN 2 THEN 'x' END AS identifier,
CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '7' END AS title, ['high', 'informational', 'unknown'][p_partkey % 7 + 1] AS severity, ['test', 'unknown', 'unknown'][p_partkey % 7 + 1] AS status, ['sigma', 'kuery', 'unknown'][p_partkey % 7 + 1] AS language,
CASE p_partkey % 7 WHEN 1 THEN p_size END AS risk_score, CASE p_partkey % 7 WHEN 1 THEN 'q' END AS query, ['a,b', 'one', ''][p_partkey % 7 + 1] AS tags, [NULL, NULL, NULL, 'title is required', 'not a mapping', 'condition is required', 'not a mapping'][p_partkey % 7 + 1] AS fault FROM part"""


FULL = """CASE p_partkey % 4 WHEN 0 THEN concat('{"title": "', p_name, '", "description": "', p_type, '", "author": ["a", 3, "b"], "date": "2024/01/02", "version": 2, "logsource": {"category": "process_creation", "product": " ", "service": 7}, "detection": {"sel": {"Image|endswith": "', p_brand, '"}, "condition": ["sel", " ", 5, "not x"], "timeframe": "5m"}, "references": "http://x", "falsepositives": ["none"]}')
WHEN 1 THEN concat('{"name": "', p_name, '", "description": null, "author": "solo", "created_at": "c", "updated_at": "u", "type": "eql", "index": ["i-', CAST(p_size AS STRING), '", true, "j"], "query": "q", "references": ["r1", "r2"], "false_positives": "fp", "threat": [{"technique": [{"id": "T1", "subtechnique": [{"id": "T1.1"}, {"id": " "}]}]}, {"technique": [{"id": "T1"}, {"id": "T2"}]}]}')
WHEN 2 THEN '{"title": "t", "detection": {"condition": "c", "timeframe": 5}, "logsource": "x"}' ELSE '{"name": "n"}' END"""


def described_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.described(table(spark, sf_dir, "part").selectExpr("p_partkey AS rule_id", f"{FULL} AS text"))
    lists = [F.array_join(c, ",").alias(c) for c in ("authors", "indices", "condition", "references", "false_positives", "attack")]
    return rows.select("rule_id", "format", "fault", "description", "version", "created", "modified", "category", "product", "service", "timeframe", "rule_type", F.md5(F.encode(F.regexp_replace("detection", " ", ""), "UTF-8")).alias("detection"), *lists)


DESCRIBED_RULES = """SELECT p_partkey AS rule_id, ['sigma', 'elastic', 'sigma', 'unknown'][k] AS format, CASE WHEN k = 4 THEN 'no parser takes it' END AS fault, CASE k WHEN 1 THEN p_type END AS description, CASE k WHEN 1 THEN '2' END AS version, CASE k WHEN 1 THEN '2024/01/02' WHEN 2 THEN 'c' END AS created, CASE k WHEN 2 THEN 'u' END AS modified,
CASE k WHEN 1 THEN 'process_creation' END AS category, NULL::VARCHAR AS product, CASE k WHEN 1 THEN '7' END AS service, CASE k WHEN 1 THEN '5m' END AS timeframe, CASE k WHEN 2 THEN 'eql' END AS rule_type,
CASE k WHEN 1 THEN md5(replace('{"sel":{"Image|endswith":"' || p_brand || '"},"condition":["sel"," ",5,"not x"],"timeframe":"5m"}', ' ', '')) WHEN 3 THEN md5('{"condition":"c","timeframe":5}') END AS detection,
CASE k WHEN 1 THEN 'a,b' WHEN 2 THEN 'solo' WHEN 3 THEN '' END AS authors, CASE k WHEN 1 THEN '' WHEN 2 THEN 'i-' || p_size || ',j' WHEN 3 THEN '' END AS indices, CASE k WHEN 1 THEN 'sel,not x' WHEN 2 THEN '' WHEN 3 THEN 'c' END AS condition,
CASE k WHEN 1 THEN 'http://x' WHEN 2 THEN 'r1,r2' WHEN 3 THEN '' END AS "references", CASE k WHEN 1 THEN 'none' WHEN 2 THEN 'fp' WHEN 3 THEN '' END AS false_positives, CASE k WHEN 1 THEN '' WHEN 2 THEN 'T1,T1.1,T2' WHEN 3 THEN '' END AS attack
FROM (SELECT *, p_partkey % 4 + 1 AS k FROM part)"""


def attack_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS rule_id", f"{DOC} AS text").filter("text <> ''")
    return P.attack_references(rows).select("rule_id", "technique", "place")


ATTACK_REFERENCES = "SELECT p_partkey AS rule_id, t[1] AS technique, t[2] AS place FROM (SELECT p_partkey, unnest([['T1', '0.0.-1'], ['T1.1', '0.0.0'], ['T2', '0.1.-1']]) AS t FROM part WHERE p_partkey % 7 = 1)"


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as techniques, their customers as citing records, regions as parents."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("identifier"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("record_id"), "n_nationkey", "n_regionkey")
    defined = n.select("identifier", "record_id").unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("identifier"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("record_id")))
    cites = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("identifier").alias("value"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"), F.lit("sigma").alias("source"))
    cites = cites.unionByName(n.select(F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("value"), "record_id", F.lit("elastic").alias("source")))
    cases = n.select((F.col("n_nationkey") % 10).alias("case_id"), F.col("n_nationkey").alias("ordinal"), F.concat(F.lit(" "), F.lower("identifier")).alias("anchor"))
    cases = cases.unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 5).alias("case_id"), (F.col("r_regionkey") * 6).alias("ordinal"), F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("anchor")))
    return V.technique_truth(cases, defined, V.citations(cites))


GROUND_TRUTH = """WITH defined AS (SELECT 'T' || n_regionkey || '.' || n_nationkey AS i, 'n' || n_nationkey AS record_id FROM nation UNION ALL SELECT 'T' || r_regionkey, 'r' || r_regionkey FROM region),
cited AS (SELECT DISTINCT 'T' || n_regionkey || '.' || n_nationkey AS i, 'c' || c_custkey AS record_id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'T' || n_regionkey, 'n' || n_nationkey FROM nation),
cases AS (SELECT n_nationkey % 10 AS case_id, n_nationkey AS o, 'T' || n_regionkey || '.' || n_nationkey AS i FROM nation UNION ALL SELECT r_regionkey + 5, r_regionkey * 6, 'T' || r_regionkey FROM region),
g AS (SELECT case_id, o, 1 AS r, record_id, 3 AS grade FROM cases JOIN defined USING (i) UNION ALL SELECT case_id, o, 2, record_id, 2 FROM cases JOIN cited USING (i) UNION ALL SELECT case_id, o, 3, record_id, 1 FROM cases JOIN defined ON defined.i = split_part(cases.i, '.', 1) WHERE contains(cases.i, '.'))
SELECT case_id, record_id, arg_min(grade, o * 10 + r) AS grade FROM g GROUP BY ALL"""

QUERIES = {
    "hybrid_rank": (hybrid_rank, HYBRID_RANK),
    "retrieval_stats": (retrieval_stats, RETRIEVAL_STATS),
    "ablation": (ablation, ABLATION),
    "redact_documents": (redact_documents, REDACT),
    "organised_items": (organised_items, f"WITH {ORGANISED} SELECT package_id, item_id, section, place::INT AS place FROM organised"),
    "context_budget": (context_budget, CONTEXT_BUDGET),
    "section_texts": (section_texts, SECTION_TEXTS),
    "warning_ceiling": (warning_ceiling, WARNING_CEILING),
    "dropped_warnings": (dropped_warnings, DROPPED),
    "package_validate": (package_validate, PACKAGE_VALIDATE),
    "identifier_boundary": (identifier_boundary, IDENTIFIER),
    "rule_validate": (rule_validate, f"{RULE_VALIDATE} SELECT * FROM issues"),
    "validation_report": (validation_report, VALIDATION_REPORT),
    "ledger_outer_join": (ledger_outer_join, LEDGER),
    "fabricated_claims": (fabricated_claims, FABRICATED),
    "rating_bands": (rating_bands, RATING),
    "format_json": (format_json, FORMAT_JSON),
    "parsed_rules": (parsed_rules, PARSED_RULES),
    "described_rules": (described_rules, DESCRIBED_RULES),
    "attack_references": (attack_references, ATTACK_REFERENCES),
    "ground_truth": (ground_truth, GROUND_TRUTH),
}
