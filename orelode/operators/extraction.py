"""All entities of rules, by the extractors in their fixed order.

Rules have ``rule_id, detection`` (JSON text of the named blocks), ``query``, and metadata columns. Entities are never
merged: each says where it stands, and who found it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import entities as E
from orelode.operators import vocabulary as V
from orelode.operators.mapping import split_field

EXTRACTORS = (*V.ROUTES, "field", "metadata")
DOTTED = r"[a-z_@][A-Za-z0-9_@\-]*(?:\.[A-Za-z0-9_@\-]+)+"
#: Keys of a detection that are no blocks of it.
RESERVED = r"^detection\.(?:condition|timeframe)(?:\[|\z)"
COLUMNS = ("rule_id", "entity_type", "value", "source_field", "location", "section", "extractor")
#: Metadata columns: entity type, source field, location, section.
METADATA = (
    ("authors", "author", "author", "metadata.authors", "metadata"), ("severity", "severity", "severity", "metadata.severity", "metadata"), ("status", "status", "status", "metadata.status", "metadata"), ("tags", "tag", "tags", "tags", "tags"),
    ("attack", "tag", "threat", "threat", "tags"), ("references", "reference", "references", "references", "references"), ("product", "product", "product", "log_source.product", "log_source"), ("category", "category", "category", "log_source.category", "log_source"),
    ("service", "log_source_service", "service", "log_source.service", "log_source"), ("indices", "log_index", "index", "log_source.indices", "log_source"), ("timeframe", "timeframe", "timeframe", "condition.timeframe", "condition"),
)


def occurrences(rules: DataFrame) -> DataFrame:
    """``rule_id, field, value, location, walked``: values of the blocks, then pairs of the query."""
    walked = E.nested_values(rules.select("rule_id", "detection")).filter(~F.col("location").rlike(RESERVED)).select("rule_id", "n", "field", "value", "location", F.lit(True).alias("walked"))
    stated = E.query_pairs(rules.select("rule_id", "query")).select("rule_id", F.col("n") + 1_000_000, "field", "value", "location", F.lit(False))
    return walked.union(stated)


def scopes(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Texts that shapes are read from: values of the blocks, and the query as a whole."""
    own = found.filter("walked").select("rule_id", "n", F.col("field").alias("source_field"), F.col("value").alias("text"), "location")
    return own.union(rules.filter(stripped("query") != "").select("rule_id", F.lit(2_000_000), F.lit("query"), "query", F.lit("detection.query")))


def entity(kind: Column, value: Column, field: Column, location: Column, section: Column, extractor: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip((kind, value, field, location, section, extractor), COLUMNS[1:], strict=True)]


def fields(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Fields and modifiers of each occurrence, and dotted names before a separator that no occurrence states."""
    section, extractor = F.lit("detection"), F.lit("field")
    base, modifiers = split_field(F.col("field"))
    named = found.filter("field <> ''")
    one = named.select("rule_id", "n", *entity(F.lit("field"), base, F.col("field"), F.col("location"), section, extractor))
    more = named.select("rule_id", "n", "field", "location", F.explode(modifiers).alias("m")).select("rule_id", "n", *entity(F.lit("field_modifier"), F.col("m"), F.col("field"), F.col("location"), section, extractor))
    hits = F.array_distinct(F.regexp_extract_all(F.col("query"), F.lit(rf"(?<![A-Za-z0-9_.@\-])({DOTTED})(?=\s*(?::|==|!=))"), F.lit(1)))
    swept = rules.filter("query IS NOT NULL").select("rule_id", F.explode(hits).alias("name"))
    said = found.select("rule_id", F.col("field").alias("name")).union(found.select("rule_id", "value")).distinct()
    rest = swept.join(said, ["rule_id", "name"], "left_anti").select("rule_id", F.lit(3_000_000).alias("n"), *entity(F.lit("field"), F.col("name"), F.lit("query"), F.lit("detection.query"), section, extractor))
    return one.unionByName(more).unionByName(rest)


def metadata(rules: DataFrame) -> DataFrame:
    """Entities of the metadata columns that the rules have; blank values are none."""
    parts = []
    for i, (column, kind, field, location, section) in enumerate(METADATA):
        if column in rules.columns:
            value = F.col(column) if rules.schema[column].dataType.typeName() == "array" else F.array(F.col(column).cast("string"))
            parts.append(_typed(value, i, kind, field, location, section))
    rows = rules.select("rule_id", F.inline(F.flatten(F.array(*parts)))).filter(stripped("value") != "")
    return rows.select("rule_id", "n", "entity_type", "value", "source_field", "location", "section", F.lit("metadata").alias("extractor"))


def _typed(value: Column, i: int, kind: str, field: str, location: str, section: str) -> Column:
    said = F.coalesce(value, F.array().cast("array<string>"))
    return F.transform(said, lambda v, j: F.struct((F.lit(i * 1000) + j).alias("n"), v.alias("value"), F.lit(kind).alias("entity_type"), F.lit(field).alias("source_field"), F.lit(location).alias("location"), F.lit(section).alias("section")))


def extracted(rules: DataFrame, types: tuple[str, ...] | None = None, registry: Registry | None = None) -> DataFrame:
    """Entities of rules with ``ordinal``; only of these types if given. ``registry``: these extractors, in their order.

    A caller's own extractors run with the standard ones, and not at all where none of their types is asked for.
    """
    registry = registry or Registry.standard()
    wanted = registry.names if types is None else tuple(dict.fromkeys(n for t in types for n in registry.names if t in registry.names[n]))
    found = occurrences(rules)
    parts = []
    if set(wanted) & set(V.ROUTES):
        parts.append(E.routed(found).select("rule_id", "n", *entity(F.col("entity_type"), F.col("value"), F.col("field"), F.col("location"), F.lit("detection"), F.col("extractor"))))
        parts.append(E.shapes(scopes(rules, found).withColumnRenamed("n", "at"), "text", "source_field").select("rule_id", (F.col("at") + 4_000_000).alias("n"), *entity(F.col("entity_type"), F.col("value"), F.col("source_field"), F.col("location"), F.lit("detection"), F.col("extractor"))))
    if "field" in wanted:
        parts.append(fields(found, rules))
    if "metadata" in wanted:
        parts.append(metadata(rules))
    for name in wanted:
        if name in registry.runs:
            own = registry.runs[name](rules, found)
            parts.append(own.select("rule_id", F.col("n").cast("long").alias("n"), *entity(*[F.col(c) for c in COLUMNS[1:-1]], F.lit(name))).filter(F.col("entity_type").isin(*registry.names[name])))
    if not parts:
        return rules.sparkSession.createDataFrame([], ", ".join([f"rule_id {dict(rules.dtypes)['rule_id']}", *(f"{c} string" for c in COLUMNS[1:]), "ordinal long"]))
    out = reduce(DataFrame.unionByName, parts).filter(F.col("extractor").isin(*wanted))
    if types is not None:
        out = out.filter(F.col("entity_type").isin(*types))
    order = (F.array_position(F.array(*map(F.lit, registry.names)), F.col("extractor")).cast("long")) * 100_000_000 + F.col("n")
    return out.withColumn("ordinal", order).drop("n")


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    return rows.filter(F.col("entity_type").isin(*types))


def of_section(rows: DataFrame, section: str) -> DataFrame:
    return rows.filter(F.col("section") == section)


def by_extractor(rows: DataFrame, extractor: str) -> DataFrame:
    return rows.filter(F.col("extractor") == extractor)


def values_of(rows: DataFrame, entity_type: str) -> DataFrame:
    """``rule_id, values``: a type's values in their order, repeats too."""
    return of_type(rows, entity_type).groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("values"))


def grouped(rows: DataFrame) -> DataFrame:
    """``rule_id, entity_type, n, values`` for each type of a rule."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "value")))
    return rows.groupBy("rule_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.transform(listed, lambda x: x["value"]).alias("values"))


class Registry:
    """Extractors by name in their order, the entity types that each can produce, and what a caller's own ones do.

    An own extractor is a function of rules and their occurrences (``rule_id, n, field, value, location, walked``) to
    ``rule_id, n, entity_type, value, source_field, location, section``, where ``n`` is its order within a rule.
    """

    def __init__(self):
        self.names: dict[str, tuple[str, ...]] = {}
        self.runs: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

    @classmethod
    def standard(cls) -> Registry:
        out = cls()
        for name, types in V.ROUTES.items():
            out.register(name, (*types, *(k for k, (e, _) in E.SHAPES.items() if e == name and k not in types)))
        out.register("field", ("field", "field_modifier"))
        out.register("metadata", tuple(dict.fromkeys(m[1] for m in METADATA)))
        return out

    def register(self, name: str, types: tuple[str, ...], run: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        if name in self.names:
            raise ValueError(f"extractor {name} is registered already")
        if run is None and name not in EXTRACTORS:
            raise ValueError(f"extractor {name} isn't a standard one, so it needs a function")
        self.names[name] = types
        if run is not None:
            self.runs[name] = run

    def by_name(self, name: str) -> tuple[str, ...]:
        if name not in self.names:
            raise KeyError(f"no extractor {name}")
        return self.names[name]

    def producing(self, entity_type: str) -> tuple[str, ...]:
        """Extractors that can produce a type; an error if none can."""
        found = tuple(n for n, types in self.names.items() if entity_type in types)
        if not found:
            raise KeyError(f"no extractor produces {entity_type}")
        return found


def present_types(rows: DataFrame) -> DataFrame:
    """Types of each rule in the order they are first seen."""
    first = rows.groupBy("rule_id", "entity_type").agg(F.min("ordinal").alias("o"))
    return first.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "entity_type"))), lambda x: x["entity_type"]).alias("types"))
