"""A whole graph from records: nodes of each source, edges of resolved references and tags, merges, and stores.

Records have ``source, line_number, id, source_id, text, metadata`` (a variant), as ``sources.corpus`` gives them. The
build visits sources in ``ORDER``; of nodes with one id, and of edges with one key, the first in that order stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import graph as G
from orelode.operators import references as R
from orelode.session import settled
from orelode.sources import store

#: The order of the build, objects that become nodes, and what a rule's source is called: fixed values.
ORDER = ("mitre", "ecs", "sigma", "elastic", "lolbas")
OBJECTS = {"technique": "technique", "tactic": "tactic", "software": "software", "group": "group", "mitigation": "mitigation", "campaign": "campaign", "data-source": "data_source"}
RULES = ("sigma", "elastic")
#: Keys of the evidence of nodes and edges, as a store gets them: fixed values.
NODE_EVIDENCE = ("prov_source", "prov_source_id", "prov_record_id", "prov_dataset", "prov_line")
EDGE_EVIDENCE = ("source", "source_id", "source_field", "source_location", "original_value", "canonical_id", "resolution_status", "resolution_method", "origin", "evidence")


def build_order(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ORDER)), source)


def chosen(records: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Records of the sources that a build visits: all in ``ORDER``, or those of them that are given."""
    return records.filter(F.col("source").isin(*[s for s in ORDER if sources is None or s in sources]))


def record_nodes(records: DataFrame, dataset: Column | None = None) -> DataFrame:
    """A node for each record that stands for something: ``record_id, node_id, node_type, source, source_id, canonical_id,
    name, properties, evidence, build_ord, line_number``.

    An ATT&CK object needs a known type and an identifier; a rule is keyed by its rule id, all else by its source id.
    """
    text = lambda key: R.text_of(F.col("metadata"), key)
    source, kind = F.col("source"), text("objectType")
    said = lambda c: F.when(c != "", c)
    object_type = F.lit(None).cast("string")
    for name, node in OBJECTS.items():
        object_type = F.when(kind == name, node).otherwise(object_type)
    rows = R.normalized(records).withColumns({"attack_id": F.coalesce(said(text("techniqueId")), said(text("id"))), "object_kind": kind, "rule_id": said(text("ruleId"))})
    rows = rows.withColumn("node_type", F.when(source == "mitre", F.when(F.col("attack_id").isNotNull(), object_type)).when(source.isin(*RULES), "rule").when(source == "lolbas", "lolbas_entry").when(source == "ecs", "ecs_field")).filter("node_type IS NOT NULL")
    canonical = F.when(source.isin(*RULES), F.coalesce("rule_id", "source_id")).otherwise(F.col("source_id"))
    mitre = G.properties(objectType=kind, domain=text("domain"), attackId=F.col("attack_id"), url=F.col("url"))
    rule = G.properties(category=source, ruleType=text("type"), level=F.coalesce(said(text("level")), text("severity")), status=F.coalesce(said(text("status")), text("maturity")), url=F.col("url"))
    other = G.properties(objectType=kind, fieldSet=text("fieldSet"), platform=text("platform"), url=F.col("url"))
    file = dataset if dataset is not None else F.concat(source, F.lit(".jsonl"))
    evidence = F.map_from_arrays(F.array(*map(F.lit, NODE_EVIDENCE)), F.array(source, F.col("source_id"), F.col("id"), file, F.col("line_number").cast("string")))
    return rows.select(
        F.col("id").alias("record_id"), G.node_id(source, F.col("node_type"), canonical).alias("node_id"), "node_type", "source", "source_id", canonical.alias("canonical_id"), F.col("title").alias("name"),
        F.when(source == "mitre", mitre).when(source.isin(*RULES), rule).otherwise(other).alias("properties"), evidence.alias("evidence"), build_order(source).alias("build_ord"), "line_number",
    )


def stated_tactics(records: DataFrame) -> DataFrame:
    """References of techniques to tactics that are stated as objects: the columns of ``references``."""
    tactics = F.transform(F.try_variant_get("metadata", "$.tactics", "array<variant>"), lambda t: F.when(F.schema_of_variant(F.try_variant_get(t, "$.tacticId", "variant")) == "STRING", F.try_variant_get(t, "$.tacticId", "string")))
    rows = records.filter("source = 'mitre'").select("source", "id", F.posexplode(tactics).alias("ordinal", "v")).filter(stripped("v") != "")
    return rows.select("source", "id", (F.col("ordinal") + 1_000_000).alias("ordinal"), F.lit("tactics.tacticId").alias("field"), F.upper(stripped("v")).alias("value"), F.lit("tactic").alias("kind"))


def edge_evidence(source: Column, source_id: Column, field: Column, value: Column, canonical: Column, status: str, method: str, origin: str, evidence: Column) -> Column:
    place = F.concat_ws(":", source, source_id, field)
    return F.map_from_arrays(F.array(*map(F.lit, EDGE_EVIDENCE)), F.array(source, source_id, field, place, value, F.coalesce(canonical, F.lit("")), F.lit(status), F.lit(method), F.lit(origin), F.coalesce(evidence, F.lit(""))))


def placed_index(normal: DataFrame) -> DataFrame:
    """The identifiers of normalized records, which are candidates in the order of the build."""
    return R.identifier_index(normal.withColumn("place", F.struct(build_order(F.col("source")).alias("o"), "line_number")), keep=("source", "id", "place"))


def skipped_candidates(records: DataFrame, skipped: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    """``candidate_set, place, record`` of the ambiguous references that a build of these records skipped."""
    return R.candidate_sets(placed_index(R.normalized(chosen(records, sources))), skipped, order="place", scope="source")


def reference_edges(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the records' references (``key, type, start_id, end_id, evidence, build_ord, line_number, ordinal``), and what was skipped.

    Two records' evidence for the same pair of nodes makes two edges: source, its id, the field and the value are in the key.
    """
    own = nodes.select(F.col("record_id").alias("id"), "source", F.col("node_id").alias("start_id"), F.col("node_type").alias("start_type"), "source_id", "build_ord", "line_number")
    refs = R.references(records).unionByName(stated_tactics(records)).join(own, ["source", "id"]).withColumn("ref", F.struct("source", "id", "line_number", "ordinal"))
    normal = R.normalized(records)
    found = R.resolved_by_kind(refs, placed_index(normal), order="place")
    target = nodes.groupBy("record_id").agg(F.max_by(F.struct("node_id", "node_type"), F.struct("build_ord", "line_number")).alias("t"))
    named = normal.select(F.col("id").alias("target_record"), F.coalesce(R.text_of(F.col("metadata"), "techniqueId"), R.text_of(F.col("metadata"), "id")).alias("target_name"), F.struct(build_order(F.col("source")).alias("o"), "line_number").alias("p")).groupBy("target_record").agg(F.min_by("target_name", "p").alias("target_name"))
    rows = found.withColumn("target_record", F.col("record"))
    rows = rows.join(target.select(F.col("record_id").alias("target_record"), "t.*"), "target_record", "left").join(named, "target_record", "left")
    rows = settled(rows.drop("ref").withColumn("reason", F.when(F.col("status") == "unresolved", G.SKIPS[0]).when(F.col("status") == "ambiguous", G.SKIPS[1]).when(F.col("node_id").isNull(), G.SKIPS[2])))  # read twice
    kind = G.edge_type(F.col("start_type"), F.col("node_type"), F.col("field"))
    edges = rows.filter("reason IS NULL").withColumn("type", kind).select(
        G.edge_key(F.col("start_id"), F.col("type"), F.col("node_id"), F.col("source"), F.col("source_id"), F.col("field"), F.col("value")).alias("key"), "type", "start_id", F.col("node_id").alias("end_id"),
        edge_evidence(F.col("source"), F.col("source_id"), F.col("field"), F.col("value"), F.col("target_name"), "resolved", "identifier_index", "resolved_reference", F.col("target_record")).alias("evidence"), "build_ord", "line_number", "ordinal",
    )
    skipped = rows.filter("reason IS NOT NULL").select("reason", "source", "source_id", F.col("field").alias("source_field"), F.col("value").alias("original_value"), F.when(F.col("reason") == G.SKIPS[1], F.col("candidate_set")).alias("candidate_set"), F.coalesce("note", F.lit("the record stands for no node")).alias("note"))
    return edges, skipped


def tag_parts(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the records' tags, and of the CVE that a tag spells."""
    listed = F.try_variant_get("metadata", "$.tags", "array<variant>")
    tags = F.filter(F.transform(listed, lambda t: F.when(F.schema_of_variant(t) == "STRING", stripped(F.try_variant_get(t, "$", "string")))), lambda t: t.isNotNull() & (t != ""))
    rows = records.select("source", "id", "source_id", "line_number", F.posexplode(tags).alias("ordinal", "tag"))
    rows = rows.join(nodes.select("source", F.col("record_id").alias("id"), F.col("node_id").alias("start_id"), "build_ord"), ["source", "id"])
    cve = r"(?i)^cve[._-](\d{4})[._-](\d{4,})$"
    rows = rows.withColumn("cve", F.when(F.col("tag").rlike(cve), F.concat(F.lit("CVE-"), F.regexp_extract("tag", cve, 1), F.lit("-"), F.regexp_extract("tag", cve, 2))))
    ends = {"tag": ("has_tag", F.col("tag"), F.lit("tag"), "not_applicable", F.lit("")), "external_reference": ("references", F.col("cve"), F.lit("cve"), "external", F.lit("no source describes it"))}
    edges, made = None, None
    for step, (node_type, (kind, ident, scheme, status, evidence)) in enumerate(ends.items()):
        of = rows.filter(ident.isNotNull())
        canonical = ident if node_type == "tag" else F.concat_ws(":", scheme, ident)
        end = G.node_id(F.lit("derived"), F.lit(node_type), canonical)
        e = of.select(G.edge_key(F.col("start_id"), F.lit(kind), end, F.col("source"), F.col("source_id"), F.lit("tags"), F.col("tag")).alias("key"), F.lit(kind).alias("type"), "start_id", end.alias("end_id"), edge_evidence(F.col("source"), F.col("source_id"), F.lit("tags"), F.col("tag"), ident, status, "literal", "literal_metadata", evidence).alias("evidence"), "build_ord", "line_number", (F.lit(2_000_000) + F.col("ordinal") * 2 + step).alias("ordinal"))
        properties = G.properties(scheme=scheme) if node_type == "tag" else G.properties(scheme=scheme, identifier=ident, described=F.lit("false"))
        n = of.groupBy(end.alias("node_id"), canonical.alias("canonical_id"), ident.alias("source_id"), properties.cast("string").alias("as_text")).agg(F.first(properties).alias("properties")).select("node_id", F.lit(node_type).alias("node_type"), "source_id", "canonical_id", (F.col("source_id") if node_type == "tag" else F.lit(None).cast("string")).alias("name"), "properties")
        edges, made = (e, n) if edges is None else (edges.unionByName(e), made.unionByName(n))
    none = F.lit(None)
    return made.withColumns({"record_id": none.cast("string"), "source": none.cast("string"), "evidence": none.cast("map<string,string>"), "build_ord": F.lit(len(ORDER) + 1).cast("long"), "line_number": F.lit(0)}), edges


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, by a partial aggregate."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(key, "first.*")


def built(records: DataFrame, sources: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skipped references of the records of these sources.

    A part of the sources is a graph by itself: references to the rest are unresolved or find no node.
    """
    some = settled(chosen(records, sources))  # read once for nodes, references, their index, names and tags
    own = settled(record_nodes(some))
    edges, skipped = reference_edges(some, own)
    derived, tagged = tag_parts(some, own)
    nodes = first_of(own.unionByName(derived.select(own.columns)), "node_id", "build_ord", "line_number", "record_id")
    edges = first_of(edges.unionByName(tagged), "key", "build_ord", "line_number", "ordinal", "start_id")
    return settled(nodes), settled(edges), skipped


def stored(records: DataFrame, path: str, sources: tuple[str, ...] | None = None) -> dict[str, int]:
    """Builds the graph and merges it into the store below ``path``: nodes by their id, edges by their key.

    What earlier builds stored stays, unless this one has it too; the same build again writes nothing. ``skipped`` is what
    this build skipped. Says how many records were read, and nodes and edges added, changed and written anew.
    """
    nodes, edges, skipped = built(records, sources)
    skipped.write.mode("overwrite").parquet(f"{path}/skipped")
    out = {"records_read": chosen(records, sources).count(), "skipped": records.sparkSession.read.parquet(f"{path}/skipped").count()}
    for name, rows, key in (("nodes", nodes, "node_id"), ("edges", edges, "key")):
        told = store.merge(rows, f"{path}/{name}", key)
        out |= {f"{name}_{what}": told[what] for what in ("added", "changed", "written")}
    return out


def stored_graph(records: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a store, with the columns of a build."""
    nodes, edges, _ = built(records.limit(0))
    spark = records.sparkSession
    return store.read(spark, f"{path}/nodes", nodes.schema), store.read(spark, f"{path}/edges", edges.schema)


def problems(nodes: DataFrame, edges: DataFrame, skipped: DataFrame) -> DataFrame:
    """(code, subject): what ``graph.problems`` finds, nodes of a source without evidence, and edges to what is ambiguous."""
    plain = G.problems(nodes, edges.select("key", "start_id", "end_id", F.col("evidence")["source_field"].alias("field")))
    bare = nodes.filter("source IS NOT NULL AND evidence IS NULL").select(F.lit("node_without_evidence").alias("code"), F.col("node_id").alias("subject"))
    settled = edges.filter(F.col("evidence")["resolution_status"] == "ambiguous").select(F.lit("ambiguous_target").alias("code"), F.col("key").alias("subject"))
    unsure = skipped.filter(F.col("reason") == G.SKIPS[1]).select("original_value").distinct()
    named = edges.withColumn("original_value", F.col("evidence")["original_value"]).filter(F.col("evidence")["canonical_id"] != "").join(unsure, "original_value", "left_semi").select(F.lit("ambiguous_target").alias("code"), F.col("key").alias("subject"))
    return plain.unionByName(bare).unionByName(settled).unionByName(named)


def diagnostics(skipped: DataFrame) -> DataFrame:
    """Skipped references by reason, zero where there are none."""
    return G.type_counts(skipped, "reason", G.SKIPS)


def neighbours_by_record(nodes: DataFrame) -> DataFrame:
    """The node that a record's id stands for: the last one, where several records share an id."""
    last = Window.partitionBy("record_id").orderBy(F.desc("build_ord"), F.desc("line_number"))
    return nodes.filter("record_id IS NOT NULL").withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")
