"""Evidence packages from rules, entities, mappings, retrieval and seeds, for many requests at once.

Each input gives items and warnings. Items have ``package_id, item_id, section, kind, ordinal, text, status, priority,
rank, score, hops, origin, source, source_id, record_id, chunk_id, location, paths, metadata``, warnings ``package_id,
batch, ordinal, code, detail, item_id, section``. A package is its items in order and within a budget, then a section of
its warnings with a ceiling of its own, then one item that describes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import context as C
from orelode.session import settled

OPERATIONS = ("analyze", "enhance", "generate")
#: Order classes of items: a lower one goes first. Fixed values.
EXACT, GRAPH, ENTITY, LEXICAL, UNSPECIFIED = 0, 1, 2, 3, 9
BATCHES = ("rule", "entities", "mappings", "retrieval", "seeds", "references", "budget")
ITEM = "package_id string, item_id string, section string, kind string, ordinal long, text string, status string, priority int, rank int, score double, hops int, origin string, source string, source_id string, record_id string, chunk_id string, location string, paths array<string>, metadata map<string,string>"
WARNING = "package_id string, batch int, ordinal long, code string, detail string, item_id string, section string"
#: Fields that only a holder of credentials has, and kinds of items that must be traced to a record.
ACCESSORS, TRACED = ("reveal", "_value"), ("retrieved_text", "retrieved_graph")


def refuse_secrets(*inputs: DataFrame | None) -> None:
    """An error if an input has the fields of a credential holder, at any depth: secrets don't belong in a package."""
    def names(kind) -> set[str]:
        own = {f.name for f in getattr(kind, "fields", ())}
        inner = [f.dataType for f in getattr(kind, "fields", ())] + [x for x in (getattr(kind, "elementType", None), getattr(kind, "valueType", None)) if x is not None]
        if set(ACCESSORS) <= own:
            raise ValueError("an input exposes a credential accessor")
        for k in inner:
            names(k)
        return own

    for df in inputs:
        if df is not None:
            names(df.schema)


def shaped(rows: DataFrame, schema: str, **columns: Column) -> DataFrame:
    """``rows`` in a schema; what isn't given is null."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def item_id(section: Column | str, n: Column) -> Column:
    return F.format_string("%s:%04d", F.lit(section) if isinstance(section, str) else section, n)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``at``, counted from 0 within a package."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("package_id").orderBy(*order)) - 1)


def empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def masked(rows: DataFrame) -> DataFrame:
    """``rows`` with their text redacted and ``fired``."""
    return C.redacted(rows).drop("text").withColumnRenamed("redacted", "text")


def redaction_warnings(rows: DataFrame, batch: str, where: str) -> DataFrame:
    hit = rows.filter(F.size("fired") > 0)
    return shaped(hit, WARNING, package_id=F.col("package_id"), batch=F.lit(BATCHES.index(batch)), ordinal=F.col("ordinal"), code=F.lit("credential_redacted"), detail=F.concat(F.lit("masked "), F.array_join("fired", ", "), F.lit(f" in {where}")), item_id=F.col("item_id"), section=F.col("section"))


def rule_context(rules: DataFrame, key: str = "rule_id", raw: str = "text") -> DataFrame:
    """What a package says of a parsed rule (``rule_parsing.described``): a row with ``package_id`` and text columns.

    Rules are settled before those with a fault are left out: a filter would move into the parsing, ahead of the tasks that
    rows are dealt to, and parse a document once for each field that a fault may lie in.
    """
    rules = settled(rules)
    said = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}="), value))
    source = F.concat_ws(", ", said("category", F.col("category")), said("product", F.col("product")), said("service", F.col("service")), said("indices", F.array_join("indices", ",")))
    condition = F.when(F.size("condition") == 1, F.get("condition", F.lit(0))).otherwise(F.array_join("condition", " or "))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tags", "references", "false_positives")]
    return rules.filter("fault IS NULL").select(F.col(key).cast("string").alias("package_id"), blank("title").alias("title"), blank("identifier").alias("identifier"), F.col("format"), F.coalesce("language", F.lit("unknown")).alias("language"), blank("query").alias("query"), F.coalesce(condition, F.lit("")).alias("condition"), source.alias("log_source"), *lists, blank(raw).alias("raw_text"))


def rule_header(rule: str = "") -> Column:
    """Labelled lines of what a rule says of itself; lines without a value are left out."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Title", F.col("title")), line("Identifier", F.col("identifier")), line("Format", F.col("format")), line("Language", F.col("language")), line("Log source", F.col("log_source")), line("Tags", F.array_join("tags", ", ")), line("False positives", F.array_join("false_positives", "; ")))


def rule_detection() -> Column:
    """The query and the condition; the rule's own text if it has neither."""
    said = F.concat_ws("\n", F.when(F.col("query") != "", F.concat(F.lit("Query:\n"), F.col("query"))), F.when(F.col("condition") != "", F.concat(F.lit("Condition: "), F.col("condition"))))
    return F.when(said != "", said).otherwise(F.col("raw_text"))


def rule_batch(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks = F.filter(F.array(F.struct(F.lit("rule_text").alias("kind"), rule_header().alias("text")), F.struct(F.lit("rule_detection").alias("kind"), rule_detection().alias("text"))), lambda b: stripped(b["text"]) != "")
    rows = rules.select("package_id", F.posexplode(blocks).alias("ordinal", "b")).select("package_id", "ordinal", "b.kind", "b.text")
    rows = masked(rows.withColumns({"item_id": item_id("rule", F.col("ordinal")), "section": F.lit("rule")}))
    items = shaped(rows, ITEM, **{c: F.col(c) for c in ("package_id", "item_id", "section", "kind", "ordinal", "text")}, status=F.lit("not_applicable"), priority=F.lit(EXACT), origin=F.lit("caller:rule"))
    return items, redaction_warnings(rows, "rule", "the rule's text")


def entity_batch(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of entities (package_id, ordinal, entity_type, value, source_field, location, extractor)."""
    rows = numbered(entities, "ordinal")
    text = F.format_string("%s='%s' field=%s at %s", "entity_type", "value", F.when(F.coalesce("source_field", F.lit("")) != "", F.col("source_field")).otherwise("-"), "location")
    metadata = F.create_map(F.lit("entity_type"), F.col("entity_type"), F.lit("source_field"), F.coalesce("source_field", F.lit("")), F.lit("location"), F.col("location"))
    items = shaped(rows, ITEM, package_id=F.col("package_id"), item_id=item_id("entities", F.col("at")), section=F.lit("entities"), kind=F.lit("extracted_entity"), ordinal=F.col("at"), text=text, status=F.lit("not_applicable"), priority=F.lit(ENTITY), score=F.lit(1.0), origin=F.concat(F.lit("extractor:"), F.col("extractor")), metadata=metadata)
    return items, empty(entities, WARNING)


def mapping_batch(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of mapped entities (package_id, ordinal, entity_type, value, mapped): an unresolved one stays and warns."""
    m, rows = F.col("mapped"), numbered(mapped, "ordinal")
    lost = m["status"] == "unresolved"
    canonical = F.coalesce(F.when(m["canonical_id"] != "", m["canonical_id"]), F.when(m["canonical_value"] != "", m["canonical_value"]), F.lit("-"))
    text = F.concat(F.format_string("%s: %s (original='%s', status=%s, method=%s)", m["canonical_type"], canonical, F.col("value"), m["status"], m["method"]), F.coalesce(F.concat(F.lit(" note="), m["note"]), F.lit("")))
    ident = item_id("mappings", F.col("at"))
    metadata = F.create_map(F.lit("canonical_type"), m["canonical_type"], F.lit("mapping_status"), m["status"], F.lit("mapping_method"), m["method"])
    items = shaped(rows, ITEM, package_id=F.col("package_id"), item_id=ident, section=F.lit("mappings"), kind=F.lit("mapped_entity"), ordinal=F.col("at"), text=text, status=F.when(lost, "unresolved").otherwise("resolved"), priority=F.lit(ENTITY), score=F.when(lost, 0.0).otherwise(1.0), origin=F.concat(F.lit("mapper:"), F.col("entity_type")), metadata=metadata)
    detail = F.format_string("'%s' has no canonical form (%s)", F.col("value"), F.coalesce(m["note"], F.lit("no reason given")))
    return items, shaped(rows.filter(lost), WARNING, package_id=F.col("package_id"), batch=F.lit(BATCHES.index("mappings")), ordinal=F.col("at"), code=F.lit("unresolved_reference"), detail=detail, item_id=ident, section=F.lit("mappings"))


def section_of(evidence: Column) -> Column:
    return F.when(F.exists(evidence, lambda e: e.method == "graph"), "graph").otherwise("retrieval")


def retrieval_batch(results: DataFrame, chunks: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ranked results (query_id, rank, chunk_id, ...); ``asked`` (package_id) are the packages that ran a retrieval."""
    own = chunks.select("chunk_id", F.col("text"), *[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("source_id", "location")])
    rows = results.join(own, "chunk_id").withColumns({"package_id": F.col("query_id").cast("string"), "ordinal": F.col("rank").cast("long") - 1, "part": section_of(F.col("evidence"))})
    rows = masked(rows.withColumn("item_id", item_id(F.col("part"), F.col("ordinal"))).withColumn("chunk_section", F.col("section")).withColumn("section", F.col("part")))
    priority = F.when(F.col("score_exact") > 0, EXACT).when(F.col("score_graph") > 0, GRAPH).when(F.col("score_entity") > 0, ENTITY).otherwise(LEXICAL)
    walks = F.filter("evidence", lambda e: e.method == "graph")
    metadata = F.create_map(F.lit("chunk_section"), F.col("chunk_section"), *[x for k in ("exact", "graph", "lexical") for x in (F.lit(f"score_{k}"), F.format_string("%.3f", F.col(f"score_{k}")))])
    paths = F.array_distinct(F.flatten(F.transform(walks, lambda e: e.matched)))
    items = shaped(rows, ITEM, **{c: F.col(c) for c in ("package_id", "item_id", "section", "ordinal", "text", "source", "source_id", "record_id", "chunk_id", "location")}, kind=F.when(F.col("section") == "graph", "retrieved_graph").otherwise("retrieved_text"), status=F.lit("resolved"), priority=priority, rank=F.col("ordinal"), score=F.col("total"), hops=F.array_min(F.transform(walks, lambda e: e.hops)), origin=F.lit("retrieval"), paths=paths, metadata=metadata)
    none = asked.select("package_id").join(rows.select("package_id").distinct(), "package_id", "left_anti")
    bare = shaped(none, WARNING, package_id=F.col("package_id"), batch=F.lit(BATCHES.index("retrieval")), ordinal=F.lit(0), code=F.lit("empty_retrieval"), detail=F.lit("retrieval found nothing, so no retrieved evidence is here"))
    return items, bare.unionByName(redaction_warnings(rows, "retrieval", "a retrieved chunk"))


def successor_records(reports: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, ordinal`` of redirected seeds with their successor's record and its text: all its chunks, a blank line between."""
    moved = reports.filter("status = 'redirected'").select("query_id", "ordinal", F.get("node_ids", F.lit(0)).alias("node_id"))
    listed = F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_id", "text")))
    texts = chunks.groupBy("record_id").agg(F.array_join(F.transform(listed, lambda c: c["text"]), "\n\n").alias("record_text"), F.transform(listed, lambda c: c["chunk_id"]).alias("record_chunks"), F.first("source").alias("record_source"))
    name = F.col("name") if "name" in nodes.columns else F.lit(None).cast("string")
    return moved.join(nodes.select("node_id", "record_id", name.alias("record_name")), "node_id").join(texts, "record_id")


def seed_batch(reports: DataFrame, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of seed reports (query_id, ordinal, value, status, node_ids, successor), every one, also those that failed; and the
    records that redirected ones led to (``successor_records``), which are never called resolved."""
    rows = numbered(reports.withColumn("package_id", F.col("query_id").cast("string")), "ordinal")
    listed, via = F.when(F.size("node_ids") > 0, F.array_join("node_ids", ", ")).otherwise("none"), F.coalesce(F.concat(F.lit(" -> "), F.col("successor")), F.lit(""))
    ident = item_id("knowledge", F.col("at"))
    metadata = F.create_map(F.lit("identifier"), F.col("value"), F.lit("status"), F.col("status"), F.lit("candidate_count"), F.size("node_ids").cast("string"), F.lit("candidates"), F.array_join("node_ids", ","), F.lit("resolved_identifier"), F.coalesce("successor", F.lit("")))
    items = shaped(rows, ITEM, package_id=F.col("package_id"), item_id=ident, section=F.lit("knowledge"), kind=F.lit("seed_resolution"), ordinal=F.col("at") * 2, text=F.format_string("identifier %s%s: %s (candidates: %s)", F.col("value"), via, F.col("status"), listed), status=F.col("status"), priority=F.lit(EXACT), origin=F.lit("seed"), metadata=metadata)
    code = F.when(F.col("status") == "redirected", "redirected_reference").when(F.col("status") == "ambiguous", "ambiguous_reference").otherwise("unresolved_reference")
    detail = F.when(F.col("status") == "redirected", F.format_string("%s was withdrawn for %s, which the corpus has", "value", "successor")).when(F.col("status") == "ambiguous", F.format_string("%s names %d records, of which none is taken", F.col("value"), F.size("node_ids"))).otherwise(F.format_string("%s names no record", F.col("value")))
    warnings = shaped(rows.filter("status <> 'resolved'"), WARNING, package_id=F.col("package_id"), batch=F.lit(BATCHES.index("seeds")), ordinal=F.col("at") * 2, code=code, detail=detail, item_id=ident, section=F.lit("knowledge"))
    if records is None:
        return items, warnings
    more = rows.drop("record_id").join(records.drop("node_id"), ["query_id", "ordinal"]).withColumns({"item_id": F.concat(ident, F.lit(":successor")), "section": F.lit("knowledge"), "ordinal": F.col("at") * 2 + 1, "text": F.col("record_text")})
    more = masked(more)
    metadata = F.create_map(F.lit("identifier"), F.col("value"), F.lit("status"), F.col("status"), F.lit("resolved_identifier"), F.col("successor"), F.lit("successor_name"), F.coalesce("record_name", F.lit("")), F.lit("successor_record"), F.col("record_id"), F.lit("successor_chunks"), F.array_join("record_chunks", ","), F.lit("redacted"), F.array_join("fired", ", "))
    found = shaped(more, ITEM, **{c: F.col(c) for c in ("package_id", "item_id", "section", "ordinal", "text", "record_id")}, kind=F.lit("retrieved_graph"), status=F.lit("redirected"), priority=F.lit(GRAPH), hops=F.lit(0), origin=F.lit("redirect_successor"), source=F.col("record_source"), source_id=F.col("successor"), chunk_id=F.get("record_chunks", F.lit(0)), location=F.col("record_id"), metadata=metadata)
    return items.unionByName(found), warnings.unionByName(redaction_warnings(more, "seeds", "the record that a seed was led to"))


def reference_batch(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references that the rules themselves state."""
    rows = rules.select("package_id", F.posexplode("references").alias("ordinal", "text"))
    return shaped(rows, ITEM, package_id=F.col("package_id"), item_id=item_id("references", F.col("ordinal")), section=F.lit("references"), kind=F.lit("reference"), ordinal=F.col("ordinal"), text=F.col("text"), status=F.lit("not_applicable"), priority=F.lit(LEXICAL), origin=F.lit("caller:rule.references")), empty(rules, WARNING)


def gathered(batches: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All batches' items and warnings, each computed once."""
    return settled(reduce(DataFrame.unionByName, [i for i, _ in batches])), settled(reduce(DataFrame.unionByName, [w for _, w in batches]))


def dropped_warnings(kept: DataFrame) -> DataFrame:
    """Of items that the budget leaves nothing of (those of a section stated once), and of those that it cuts."""
    rows = kept.withColumn("at", F.col("place").cast("long"))
    gone = rows.filter("size > 0 AND kept = 0").groupBy("package_id", "section").agg(F.min("at").alias("at"), F.min_by("item_id", "at").alias("item_id"), F.count(F.lit(1)).alias("n"))
    gone = gone.select("package_id", "at", F.lit("item_dropped").alias("code"), F.when(F.col("n") == 1, "no room was left for this item").otherwise(F.format_string("no room was left for this item and %d more", F.col("n") - 1)).alias("detail"), "item_id", "section")
    cut = rows.filter("kept > 0 AND kept < size").select("package_id", "at", F.lit("item_truncated").alias("code"), F.format_string("cut from %d to %d characters", "size", "kept").alias("detail"), "item_id", "section")
    both = gone.unionByName(cut)
    return shaped(both, WARNING, package_id=F.col("package_id"), batch=F.lit(BATCHES.index("budget")), ordinal=F.col("at"), code=F.col("code"), detail=F.col("detail"), item_id=F.col("item_id"), section=F.col("section"))


def built(items: DataFrame, warnings: DataFrame, operations: DataFrame, retrievals: DataFrame | None = None, section_limit: int = C.SECTION_LIMIT, total_limit: int = C.TOTAL_LIMIT - C.RESERVED, policy: str = "trim_tail") -> tuple[DataFrame, DataFrame]:
    """Packages' final items, and all their warnings.

    ``operations`` has ``package_id, operation``, and ``retrievals`` ``package_id, mode, items, candidates``. Warnings and
    the description come after the budget, which doesn't count them.
    """
    placed = settled(C.organised(items))
    kept = settled(C.budgeted(placed, section_limit, total_limit, policy))
    cut = placed.drop("place", "section_ord").join(kept.select("package_id", "item_id", "place", "size", "kept"), ["package_id", "item_id"])
    final = cut.withColumns({"truncated": (F.col("kept") > 0) & (F.col("kept") < F.col("size")), "text": C.cut_text(F.col("text"), F.col("size"), F.col("kept")), "original_length": F.col("size")}).filter("text IS NOT NULL").drop("size", "kept")
    told = warnings.unionByName(dropped_warnings(kept))
    order = F.row_number().over(Window.partitionBy("package_id").orderBy("batch", "ordinal", "item_id", "code"))
    final, told = settled(final), settled(told.withColumn("nth", order))
    lines = told.select("package_id", F.col("nth").alias("ordinal"), F.concat_ws(" ", F.concat(F.lit("["), F.col("code"), F.lit("]")), F.col("detail"), F.when(F.col("item_id").isNotNull(), F.concat(F.lit("("), F.col("item_id"), F.lit(")")))).alias("text"))
    shown = C.within_ceiling(lines).withColumn("at", F.row_number().over(Window.partitionBy("package_id").orderBy("ordinal")) - 1)
    extra = shaped(shown, ITEM, package_id=F.col("package_id"), item_id=item_id("warnings", F.col("at")), section=F.lit("warnings"), kind=F.lit("warning"), ordinal=F.col("at"), text=F.col("text"), status=F.lit("not_applicable"), priority=F.lit(UNSPECIFIED), origin=F.lit("budget"))
    more = lambda rows: rows.withColumns({"place": F.lit(None).cast("int"), "truncated": F.lit(False), "original_length": F.length("text").cast("long")})
    final = settled(final.unionByName(more(extra)))
    final = final.unionByName(more(metadata_items(final, operations, retrievals)))
    section = F.array_position(F.array(*map(F.lit, C.SECTIONS)), F.col("section"))
    return final.withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(section, F.coalesce("place", F.lit(0)), "ordinal", "item_id"))), told.drop("nth")


def metadata_items(items: DataFrame, operations: DataFrame, retrievals: DataFrame | None) -> DataFrame:
    """One item for each package: its operation, sections with their sizes, and its retrieval. It holds no time."""
    section = F.array_position(F.array(*map(F.lit, C.SECTIONS)), F.col("section"))
    per = items.groupBy("package_id", "section").agg(F.format_string("section=%s items=%d chars=%d truncated=%s", F.first("section"), F.count(F.lit(1)), F.sum(F.length("text")), F.bool_or("truncated").cast("string")).alias("line")).withColumn("o", section)
    lines = per.groupBy("package_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]).alias("lines"))
    rows = operations.select(F.col("package_id").cast("string"), F.concat(F.lit("operation="), F.col("operation")).alias("head")).join(lines, "package_id", "left")
    last = F.lit(None).cast("string")
    if retrievals is not None:
        rows = rows.join(retrievals.select(F.col("package_id").cast("string"), F.format_string("retrieval_mode=%s items=%d candidates=%d", "mode", "items", "candidates").alias("found")), "package_id", "left")
        last = F.col("found")
    return shaped(rows, ITEM, package_id=F.col("package_id"), item_id=F.lit("metadata:0000"), section=F.lit("metadata"), kind=F.lit("metadata"), ordinal=F.lit(0), text=F.concat_ws("\n", "head", F.concat_ws("\n", "lines"), last), status=F.lit("not_applicable"), priority=F.lit(UNSPECIFIED), origin=F.lit("metadata"))


def provenance(operations: DataFrame, results: DataFrame, reports: DataFrame, entities: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """Of each package: its sources in the order of ranks, identifiers by how they fared, and how many entities it had."""
    key = lambda rows: rows.withColumn("package_id", F.col("query_id").cast("string"))
    first = key(results).groupBy("package_id", "source").agg(F.min("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    sources = first.groupBy("package_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]).alias("sources_present"), F.sum("n").alias("retrieval_items"))
    of = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("ordinal", "value", "successor")))), lambda x: x["value"] if status != "redirected" else F.concat_ws("=", x["value"], x["successor"]))
    seeds = key(reports).groupBy("package_id").agg(*[of(s).alias(f"{s}_identifiers") for s in ("unresolved", "ambiguous", "redirected")])
    out = operations.select(F.col("package_id").cast("string"), "operation").join(sources, "package_id", "left").join(seeds, "package_id", "left")
    for name, rows in (("entity_count", entities), ("mapped_count", mapped)):
        n = rows.groupBy(F.col("package_id").cast("string").alias("package_id")).agg(F.count(F.lit(1)).alias(name)) if rows is not None else operations.select(F.col("package_id").cast("string"), F.lit(0).alias(name))
        out = out.join(n, "package_id", "left")
    return out.fillna(0, ["retrieval_items", "entity_count", "mapped_count"])


def problems(items: DataFrame, section_limit: int = C.SECTION_LIMIT, total_limit: int = C.TOTAL_LIMIT - C.RESERVED) -> DataFrame:
    """(code, package_id, subject) of what breaks a package's rules: budgets, repeated ids, traces, orders, statuses, marks
    of cuts, secrets, sections, and text that isn't Unicode."""
    evidence = items.filter(~F.col("section").isin("warnings", "metadata"))
    plain = C.problems(evidence, total_limit, section_limit).filter("code NOT IN ('section_order', 'no_mark', 'secret')")
    lost = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", c) for c in ("chunk_id", "record_id", "source_id", "location", "source")]))
    untraced = items.filter(F.col("kind").isin(*TRACED) & (F.size(lost) > 0)).select(F.lit("missing_provenance").alias("code"), "package_id", F.concat_ws(" lacks ", "item_id", F.array_join(lost, ", ")).alias("subject"))
    meta, declared = F.col("metadata"), F.lower(stripped(F.coalesce(F.col("metadata")["status"], F.lit(""))))
    seed, listed = F.col("kind") == "seed_resolution", F.filter(F.split(F.coalesce(meta["candidates"], F.lit("")), ","), lambda c: c != "")
    none = lambda k: stripped(F.coalesce(meta[k], F.lit(""))) == ""
    secret = F.lit(False)
    for _, pattern, _ in C.CREDENTIALS:
        hit = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        secret = secret | F.exists(hit, lambda h: ~h.contains("[REDACTED]"))
    at = Window.partitionBy("package_id").orderBy("place", "item_id")
    section = F.array_position(F.array(*map(F.lit, C.SECTIONS)), F.col("section"))
    sort_key = F.struct("priority", F.coalesce("rank", F.lit(1 << 30)), -F.coalesce("score", F.lit(-1.0)), F.coalesce("hops", F.lit(1 << 30)), "item_id")
    rows = items.withColumns({"before": F.lag(section).over(at), "key": sort_key, "key_before": F.lag(sort_key).over(Window.partitionBy("package_id", "section").orderBy("place", "item_id"))})
    n = F.length("text")
    codes = {
        "missing_graph_path": (F.col("kind") == "retrieved_graph") & (F.col("hops") > 0) & (F.coalesce(F.size("paths"), F.lit(0)) < 1),
        "redirected_called_otherwise": seed & (declared == "redirected") & (F.col("status") != "redirected"), "redirect_successor_lost": seed & (declared == "redirected") & none("resolved_identifier"), "redirect_original_lost": seed & (declared == "redirected") & none("identifier"),
        "unresolved_called_otherwise": seed & (declared == "unresolved") & (F.col("status") != "unresolved"), "ambiguous_called_otherwise": seed & (declared == "ambiguous") & (F.col("status") != "ambiguous"),
        "ambiguous_candidates_lost": seed & (declared == "ambiguous") & (F.size(listed).cast("string") != F.coalesce(meta["candidate_count"], F.lit("0"))),
        "cut_without_length": F.col("truncated") & (F.col("original_length") <= n), "silent_cut": ~F.col("truncated") & (F.col("original_length") > n),
        "credential": secret, "section_order": F.col("before") > section, "not_in_order": F.col("section").isin("retrieval", "graph") & (F.col("key") < F.col("key_before")), "not_unicode": ~F.is_valid_utf8("text") | F.col("text").contains("�"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in codes.items()]))
    return plain.unionByName(untraced).unionByName(rows.select(F.explode(found).alias("code"), "package_id", F.col("item_id").alias("subject")))
