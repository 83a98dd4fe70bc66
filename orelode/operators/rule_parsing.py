"""Rule documents of two formats, from JSON text to one relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V

RESERVED = ("condition", "timeframe")


def has(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, f"$.{path}", "variant").isNotNull()


def kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant"))


def scalar(doc: Column, path: str) -> Column:
    """A string, or a number as one; nothing of booleans, empty strings and others."""
    shape, value = kind(doc, path), F.try_variant_get(doc, f"$.{path}", "string")
    return F.when(shape.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)") & (stripped(value) != ""), value)


def whole(doc: Column, path: str) -> Column:
    """An integer, or a string of digits as one; a boolean isn't one."""
    shape = kind(doc, path)
    return F.when(shape.rlike("^(STRING|BIGINT)"), F.try_variant_get(doc, f"$.{path}", "string").try_cast("int"))


def strings(doc: Column, path: str) -> Column:
    """The strings of an array, or a string as one."""
    many = F.filter(F.transform(F.try_variant_get(doc, f"$.{path}", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return F.when(kind(doc, path) == "STRING", F.array(F.try_variant_get(doc, f"$.{path}", "string"))).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def named(table: dict[str, str], value: Column) -> Column:
    out = F.lit("unknown")
    for k, v in table.items():
        out = F.when(F.lower(stripped(value)) == k, v).otherwise(out)
    return out


def format_of(doc: Column) -> Column:
    """The first format that takes a document."""
    sigma = kind(doc, "detection").startswith("OBJECT")
    elastic = (has(doc, "name") | has(doc, "rule_id") | has(doc, "id")) & (has(doc, "query") | has(doc, "type"))
    return F.when(doc.isNull(), "invalid").when(~F.schema_of_variant(doc).startswith("OBJECT"), "invalid").when(sigma, "sigma").when(elastic, "elastic").otherwise("unknown")


def parsed(rules: DataFrame, text: str = "text") -> DataFrame:
    """``rules`` with ``format, identifier, title, severity, status, language, risk_score, query, tags, fault``.

    ``fault`` names what a document lacks; its other columns are then null.
    """
    rows = rules.withColumn("doc", F.try_parse_json(stripped(text))).withColumn("format", format_of(F.col("doc")))
    d, sigma = F.col("doc"), F.col("format") == "sigma"
    condition = kind(d, "detection.condition").rlike("^(STRING|ARRAY)")
    fault = (
        F.when(stripped(text) == "", "empty document").when(F.col("format") == "invalid", "not a mapping").when(F.col("format") == "unknown", "no parser takes it")
        .when(sigma & scalar(d, "title").isNull(), "title is required").when(sigma & ~F.coalesce(condition, F.lit(False)), "condition is required").when(~sigma & scalar(d, "name").isNull(), "name is required")
    )
    pick = lambda a, b: F.when(F.col("fault").isNull(), F.when(sigma, a).otherwise(b))
    rows = rows.withColumn("fault", fault)
    return rows.select(
        *rules.columns, "format", pick(scalar(d, "id"), F.coalesce(scalar(d, "rule_id"), scalar(d, "id"))).alias("identifier"), pick(scalar(d, "title"), scalar(d, "name")).alias("title"),
        pick(named(V.SEVERITY_ALIASES, scalar(d, "level")), named(V.SEVERITY_ALIASES, scalar(d, "severity"))).alias("severity"), pick(named(V.STATUS_ALIASES, scalar(d, "status")), F.lit("unknown")).alias("status"),
        pick(F.lit("sigma"), named(V.LANGUAGES, scalar(d, "language"))).alias("language"), pick(F.lit(None).cast("int"), whole(d, "risk_score")).alias("risk_score"), pick(F.lit(None).cast("string"), scalar(d, "query")).alias("query"), pick(strings(d, "tags"), strings(d, "tags")).alias("tags"), "fault",
    )


def strings_said(doc: Column, path: str) -> Column:
    """``strings`` without blank ones."""
    return F.filter(strings(doc, path), lambda x: stripped(x) != "")


def described(rules: DataFrame, text: str = "text") -> DataFrame:
    """``parsed`` with all else that a rule says: who, when, where it looks, what it detects, and what it rests on.

    ``detection`` is the JSON text of a rule's named blocks in their order (its condition and timeframe stand by
    themselves), ``attack`` the techniques of its threats, each once at its first place.
    """
    rows = parsed(rules, text).withColumn("doc", F.try_parse_json(stripped(text)))
    d, sigma, good = F.col("doc"), F.col("format") == "sigma", F.col("fault").isNull()
    pick = lambda a, b: F.when(good, F.when(sigma, a).otherwise(b))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<string>")
    frame = F.when(kind(d, "detection.timeframe") == "STRING", F.try_variant_get(d, "$.detection.timeframe", "string"))
    block = F.get_json_object(stripped(text), "$.detection")
    columns = {
        "description": pick(scalar(d, "description"), scalar(d, "description")), "authors": pick(strings(d, "author"), strings(d, "author")), "version": pick(scalar(d, "version"), scalar(d, "version")),
        "created": pick(scalar(d, "date"), scalar(d, "created_at")), "modified": pick(scalar(d, "modified"), scalar(d, "updated_at")),
        "category": pick(scalar(d, "logsource.category"), none), "product": pick(scalar(d, "logsource.product"), none), "service": pick(scalar(d, "logsource.service"), none), "definition": pick(scalar(d, "logsource.definition"), none),
        "indices": pick(nothing, strings(d, "index")), "detection": pick(block, none), "condition": pick(strings_said(d, "detection.condition"), nothing), "timeframe": pick(frame, none),
        "rule_type": pick(none, scalar(d, "type")), "references": pick(strings(d, "references"), strings(d, "references")), "false_positives": pick(strings(d, "falsepositives"), strings(d, "false_positives")),
    }
    rows = rows.withColumns(columns).drop("doc")
    return rows.withColumn("attack", F.when(good, F.when(~sigma, techniques(F.col(text))).otherwise(nothing)))


def techniques(text: Column) -> Column:
    """The techniques of a rule's threats in their order, each once."""
    shape = "array<struct<technique:array<struct<id:string,subtechnique:array<struct<id:string>>>>>>"
    threat = F.try_variant_get(F.try_parse_json(text), "$.threat", shape)
    found = F.flatten(F.transform(threat, lambda t: F.flatten(F.transform(t.technique, lambda q: F.concat(F.array(q["id"]), F.coalesce(F.transform(q["subtechnique"], lambda s: s["id"]), F.array().cast("array<string>")))))))
    return F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda i: stripped(i) != ""))


def attack_references(rules: DataFrame, text: str = "text") -> DataFrame:
    """``rules`` with ``technique, place`` for each technique of their threats, distinct by the first place."""
    shape = "array<struct<technique:array<struct<id:string,subtechnique:array<struct<id:string>>>>>>"
    threat = F.try_variant_get(F.try_parse_json(text), "$.threat", shape)
    one = lambda i, j, k, ident: F.struct(i.alias("i"), j.alias("j"), k.alias("k"), ident.alias("id"))
    of = F.flatten(F.transform(threat, lambda t, i: F.flatten(F.transform(t.technique, lambda q, j: F.concat(F.array(one(i, j, F.lit(-1), q["id"])), F.coalesce(F.transform(q["subtechnique"], lambda s, k: one(i, j, k, s["id"])), F.array().cast("array<struct<i:int,j:int,k:int,id:string>>")))))))
    rows = rules.select(*rules.columns, F.inline(of)).filter(stripped("id") != "")
    return rows.groupBy(*rules.columns, F.col("id").alias("technique")).agg(F.min(F.struct("i", "j", "k")).alias("p")).select(*rules.columns, "technique", F.concat_ws(".", *[F.col(f"p.{c}").cast("string") for c in "ijk"]).alias("place"))


def raw_rules(rows: DataFrame) -> DataFrame:
    """Bare queries (rule_id, query, language) as rules of an unknown format."""
    none = F.lit(None).cast("string")
    return rows.select("rule_id", F.lit("unknown").alias("format"), none.alias("identifier"), none.alias("title"), F.lit("unknown").alias("severity"), F.lit("unknown").alias("status"), named(V.LANGUAGES, F.col("language")).alias("language"), F.lit(None).cast("int").alias("risk_score"), "query", F.array().cast("array<string>").alias("tags"), F.when(stripped("query") == "", "empty query").alias("fault"))
