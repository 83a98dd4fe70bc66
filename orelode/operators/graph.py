"""A property graph: nodes and edges with provenance, merges, constraint checks and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped

NODE_TYPES = ("technique", "tactic", "software", "group", "mitigation", "campaign", "data_source", "rule", "lolbas_entry", "ecs_field", "tag", "external_reference")
EDGE_TYPES = ("detects", "subtechnique_of", "belongs_to", "references", "has_tag", "uses_field", "uses", "mitigates", "observes")
SKIPS = ("unresolved_target", "ambiguous_target", "target_node_absent")
#: Fields of a rule that say what it detects.
DETECTION_FIELDS = ("mitreTechniques", "mitre.techniqueId", "mitreTechnique")


def node_id(prefix: Column, kind: Column, ident: Column) -> Column:
    return F.concat_ws(":", prefix, kind, ident)


def edge_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; ``order`` has to be total within a key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("nth = 1").drop("nth")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as an upsert leaves it: a partial aggregate, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def edge_type(start: Column, target: Column, field: Column) -> Column:
    return (
        F.when((start == "technique") & (target == "technique") & (field == "parentTechniqueId"), "subtechnique_of")
        .when((target == "technique") & start.isin("rule", "lolbas_entry") & field.isin(*DETECTION_FIELDS), "detects")
        .when(target == "tactic", "belongs_to")
        .otherwise("references")
    )


def reference_edges(resolved: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and what was skipped and why, of resolved references (start_id, start_type, source, source_id, field, value, status, record, n_candidates).

    Source, its id, field and value are in an edge's key, so that distinct evidence makes distinct edges.

    ``nodes`` has ``record_id, node_id, node_type``.
    """
    target = nodes.select(F.col("record_id").alias("target_record"), F.col("node_id").alias("end_id"), F.col("node_type").alias("end_type"))
    rows = resolved.withColumn("target_record", F.col("record")).join(target, "target_record", "left")
    reason = F.when(F.col("status") == "unresolved", SKIPS[0]).when(F.col("status") == "ambiguous", SKIPS[1]).when(F.col("end_id").isNull(), SKIPS[2])
    rows = rows.withColumn("reason", reason)
    kind = edge_type(F.col("start_type"), F.col("end_type"), F.col("field"))
    edges = rows.filter("reason IS NULL").withColumn("type", kind).select(edge_key(*[F.col(c).cast("string") for c in ("start_id", "type", "end_id", "source", "source_id", "field", "value")]).alias("key"), "type", "start_id", "end_id", "field", "value")
    skipped = rows.filter("reason IS NOT NULL").select("reason", "start_id", "field", "value", F.col("n_candidates").cast("int").alias("candidates"))
    return edges, skipped


def tag_edges(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derived nodes and edges of ``node_id, tags``: each tag that isn't blank, and a CVE that it spells."""
    tags = tagged.select("node_id", F.explode(F.array_distinct("tags")).alias("tag")).withColumn("tag", stripped(F.col("tag"))).filter("tag <> ''").distinct()
    cve = r"(?i)^cve[._-](\d{4})[._-](\d{4,})$"
    named = tags.filter(F.col("tag").rlike(cve)).withColumn("cve", F.concat(F.lit("CVE-"), F.regexp_extract("tag", cve, 1), F.lit("-"), F.regexp_extract("tag", cve, 2)))
    derived = lambda kind, ident: node_id(F.lit("derived"), F.lit(kind), ident)
    edges = tags.select(F.col("node_id").alias("start_id"), F.lit("has_tag").alias("type"), derived("tag", F.col("tag")).alias("end_id")).unionByName(named.select(F.col("node_id").alias("start_id"), F.lit("references").alias("type"), derived("external_reference", F.col("cve")).alias("end_id")))
    nodes = edges.select(F.col("end_id").alias("node_id")).distinct().withColumn("node_type", F.split("node_id", ":")[1])
    return nodes, edges


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, subject) of what breaks the graph's rules: ``node_id, source``; ``key, start_id, end_id, field``."""
    ids = nodes.select("node_id").distinct()
    repeated = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_node").alias("code"), F.col("node_id").alias("subject"))
    start = edges.join(ids, edges["start_id"] == ids["node_id"], "left_anti").select(F.lit("dangling_start").alias("code"), F.col("key").alias("subject"))
    end = edges.join(ids, edges["end_id"] == ids["node_id"], "left_anti").select(F.lit("dangling_end").alias("code"), F.col("key").alias("subject"))
    unsourced = edges.filter("field IS NULL OR field = ''").select(F.lit("no_source_field").alias("code"), F.col("key").alias("subject"))
    derived = F.col("node_id").startswith("derived:")
    claims = nodes.filter(derived & F.col("source").isNotNull()).select(F.lit("derived_with_source").alias("code"), F.col("node_id").alias("subject"))
    lacks = nodes.filter(~derived & F.col("source").isNull()).select(F.lit("node_without_source").alias("code"), F.col("node_id").alias("subject"))
    out = repeated
    for part in (start, end, unsourced, claims, lacks):
        out = out.unionByName(part)
    return out


def type_counts(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Rows of each type, with zero for those without any."""
    spark = rows.sparkSession
    known = F.broadcast(spark.createDataFrame([(n,) for n in names], f"{column} string"))  # a fixed list
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def properties(**values: Column) -> Column:
    """A map of the values that aren't null or blank, as strings."""
    made = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    return F.map_filter(made, lambda _, v: v.isNotNull() & (stripped(v) != ""))
