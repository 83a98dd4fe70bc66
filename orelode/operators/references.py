"""Identifiers of records, references between them, and their resolution.

A reference is resolved (one record has the identifier), ambiguous (several have, and none is chosen) or unresolved. A
record that has an identifier twice counts twice. Each distinct key is resolved once: a reference has the number of its
candidates and the id of their set, and the sets are a table of their own, so that many references to one key of many
records cost their sum and not their product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import first_seen, stripped
from orelode.operators.numbering import numbered
from orelode.session import settled

#: Shapes of identifiers, first match counts: fixed values.
KINDS = (("data_source", r"(?i)^DS\d{4}$"), ("tactic", r"(?i)^TA\d{4}$"), ("technique", r"(?i)^T\d{4}(\.\d{3})?$"), ("group", r"(?i)^G\d{4}$"), ("software", r"(?i)^S\d{4}$"), ("mitigation", r"(?i)^M\d{4}$"), ("cve", r"(?i)^CVE-\d{4}-\d{4,}$"))


def classified(value: Column) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(KINDS):
        out = F.when(stripped(value).rlike(pattern), kind).otherwise(out)
    return out


def canonical(value: Column) -> Column:
    return F.when(classified(value) == "unknown", value).otherwise(F.upper(stripped(value)))


def text_of(metadata: Column, key: str) -> Column:
    """A metadata value if it is a string; nothing is cast."""
    v = F.try_variant_get(metadata, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(metadata, f"$.{key}", "string"))


def texts_of(metadata: Column, key: str) -> Column:
    """Strings of an array, or a single string as one; an empty array otherwise."""
    v = F.try_variant_get(metadata, f"$.{key}", "variant")
    many = F.filter(F.transform(F.try_variant_get(metadata, f"$.{key}", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return F.when(F.schema_of_variant(v) == "STRING", F.array(text_of(metadata, key))).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def normalized(records: DataFrame) -> DataFrame:
    """``records`` with ``title, url, object_type, identifiers, unknown_fields``."""
    m = F.col("metadata")
    title = F.coalesce(*[text_of(m, k) for k in ("techniqueName", "name", "title", "ruleName", "binary", "command", "fieldName")])
    own = F.concat(*[F.array(text_of(m, k)) for k in ("techniqueId", "id", "ruleId", "fieldName")], F.array("source_id", "id"))
    rows = records.withColumns({"title": title, "url": text_of(m, "url"), "object_type": text_of(m, "objectType"), "identifiers": first_seen(own)})
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in ("title", "url", "object_type")], F.when(F.size("identifiers") == 0, "identifiers")), lambda x: x.isNotNull())
    return rows.withColumn("unknown_fields", missing)


def references(records: DataFrame) -> DataFrame:
    """``source, id, ordinal, field, value, kind`` of what each record's fields name, in their order."""
    m = F.col("metadata")
    pick = lambda field, values: F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))
    none = F.array().cast("array<struct<field:string,value:string>>")
    tags = F.transform(F.filter(texts_of(m, "tags"), lambda t: F.lower(t).startswith("attack.") & (classified(F.substring(t, 8, F.length(t))) != "unknown")), lambda t: F.substring(t, 8, F.length(t)))
    pairs = F.try_variant_get(m, "$.mitre", "array<struct<tacticId:string,techniqueId:string>>")
    named = F.flatten(F.transform(pairs, lambda p: F.array(F.struct(F.lit("mitre.tacticId").alias("field"), p["tacticId"].alias("value")), F.struct(F.lit("mitre.techniqueId").alias("field"), p["techniqueId"].alias("value")))))
    by = {"mitre": F.concat(pick("parentTechniqueId", F.array(text_of(m, "parentTechniqueId"))), pick("tactics", texts_of(m, "tactics"))), "sigma": F.concat(pick("mitreTechniques", texts_of(m, "mitreTechniques")), pick("tags", tags)), "elastic": F.coalesce(named, none), "lolbas": pick("mitreTechnique", texts_of(m, "mitreTechnique"))}
    found = none
    for source, refs in by.items():
        found = F.when(F.col("source") == source, refs).otherwise(found)
    kept = F.filter(found, lambda r: r["value"].isNotNull() & (stripped(r["value"]) != ""))
    rows = records.select("source", "id", F.posexplode(kept).alias("ordinal", "r"))
    return rows.select("source", "id", "ordinal", F.col("r.field").alias("field"), canonical(F.col("r.value")).alias("value"), classified(F.col("r.value")).alias("kind"))


def identifier_index(records: DataFrame, identifiers: str = "identifiers", keep: tuple[str, ...] = ("source", "id", "ordinal")) -> DataFrame:
    """``key`` (trimmed, upper-cased) for each identifier of a record."""
    return records.select(*keep, F.explode(identifiers).alias("identifier")).select(F.upper(stripped("identifier")).alias("key"), *keep)


def keyed(refs: DataFrame, value: str, scope: str | None) -> DataFrame:
    """``refs`` with ``candidate_set``: the key that they ask for, after the source that has to answer."""
    key = F.upper(stripped(F.col(value)))
    return refs.withColumn("candidate_set", key if scope is None else F.concat(F.col(scope), F.lit(":"), key))


def sets_of(index: DataFrame, order: str, record: str, scope: str | None) -> DataFrame:
    """``candidate_set, o, record`` of an identifier index."""
    key = F.col("key") if scope is None else F.concat(F.col(scope), F.lit(":"), F.col("key"))
    return index.select(key.alias("candidate_set"), F.col(order).alias("o"), F.col(record).alias("record"))


def settled_keys(refs: DataFrame, sets: DataFrame) -> DataFrame:
    """``refs`` (candidate_set) with ``status, n_candidates, record``: the record that is the only candidate.

    Candidates are counted before they meet references, so the join has a row for each key.
    """
    counts = sets.groupBy("candidate_set").agg(F.count(F.lit(1)).alias("n_candidates"), F.first("record").alias("record"))
    out = refs.join(counts, "candidate_set", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    n = F.col("n_candidates")
    return out.withColumns({"status": F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous"), "record": F.when(n == 1, F.col("record")), "candidate_set": F.when(n > 0, F.col("candidate_set"))})


def resolved(refs: DataFrame, index: DataFrame, value: str = "value", order: str = "ordinal", record: str = "id") -> DataFrame:
    """``refs`` with ``candidate_set, n_candidates, record, status``; see ``candidate_sets`` and ``listed``."""
    return settled_keys(keyed(refs, value, None), sets_of(index, order, record, None))


def candidate_sets(index: DataFrame, resolved: DataFrame, order: str = "ordinal", record: str = "id", scope: str | None = None) -> DataFrame:
    """``candidate_set, place, record``: the candidates of the sets that resolved references name, in the index's order."""
    asked = resolved.filter("candidate_set IS NOT NULL").select("candidate_set").distinct()
    return numbered(settled(sets_of(index, order, record, scope).join(asked, "candidate_set", "left_semi")), ["candidate_set"], ["o", "record"], "place").drop("o")


def listed(resolved: DataFrame, sets: DataFrame) -> DataFrame:
    """``resolved`` with ``candidates``, an array in each row: for reports of few references, as rows hold whole sets."""
    arrays = sets.groupBy("candidate_set").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda c: c["record"]).alias("candidates"))
    return resolved.join(arrays, "candidate_set", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(arrays.schema["candidates"].dataType)))


#: Candidates that are sent to all tasks, and references of a group whose sets are looked up side by side; beyond either, sets are shuffled.
SENT, WIDTH = 4_000_000, 8


def merged_sets(refs: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    """``refs`` (by, value, candidate_set) with ``n_candidates`` and ``candidates``: the records of all sets that a group of
    ``by`` names, in the index's order, in one text parted by commas. A set that a group names twice counts twice.

    A set is listed once and has a number. References are read and shuffled once, with the number of their set. Groups, which
    are small, then go to the places of their sets and look up whole sets there, so no row of a candidate and no list is
    shuffled, and groups with the same answer lie side by side, where files hold it once. Where sets hold over ``SENT``
    candidates, or a group has over ``WIDTH`` of them, lists are shuffled, one for each reference.
    """
    lists = settled(sets.groupBy("candidate_set").agg(F.sort_array(F.collect_list(F.struct("o", "record"))).alias("list")).withColumn("set", F.monotonically_increasing_id()))
    few = (lists.agg(F.sum(F.size("list"))).first()[0] or 0) <= SENT
    names = lists.select("candidate_set", "set")
    rows = refs.join(F.broadcast(names) if few else names, "candidate_set", "left").select(by, "value", "set")
    # a list of both, as one without its values would be another shuffle
    groups = rows.repartition(by).groupBy(by).agg(F.collect_list(F.struct("value", "set")).alias("refs"))
    groups = groups.select(by, F.col("refs.value").alias("values"), F.sort_array(F.array_compact("refs.set")).alias("sets"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["record"]), ",")
    none, total, n = F.array().cast(lists.schema["list"].dataType), lambda c: F.size(c).cast("long"), F.size("sets")
    out = [groups.filter(n == 0).select(by, "values", F.lit(0).cast("long").alias("n_candidates"), F.lit("").alias("candidates"))]
    if few:
        near = groups.filter((n > 0) & (n <= WIDTH)).repartitionByRange("sets", by).sortWithinPartitions("sets", by)
        near = near.select(by, F.inline(F.array(F.struct("values", "sets"))))  # else Spark drops the sort, as it does below any join
        for i in range(WIDTH):  # one broadcast, as all have the same columns
            near = near.join(F.broadcast(lists.select(F.col("set").alias(f"set_{i}"), F.col("list").alias(f"list_{i}"))), F.get("sets", F.lit(i)) == F.col(f"set_{i}"), "left")
        alone = lists.select(F.col("set").alias("only"), text(F.col("list")).alias("text"))
        near = near.join(F.broadcast(alone), F.when(n == 1, F.get("sets", F.lit(0))) == F.col("only"), "left")
        each = [F.coalesce(f"list_{i}", none) for i in range(WIDTH)]
        whole = F.when(n == 1, F.col("text")).otherwise(text(F.sort_array(F.concat(*each))))
        out.append(near.select(by, "values", sum((total(c) for c in each), F.lit(0).cast("long")).alias("n_candidates"), whole.alias("candidates")))
    far = groups.filter(n > (WIDTH if few else 0))
    met = far.select(by, "values", F.explode("sets").alias("set")).join(lists.select("set", "list"), "set")  # each set has a list
    met = met.groupBy(by).agg(F.first("values").alias("values"), F.sort_array(F.flatten(F.collect_list("list"))).alias("list"))
    out.append(met.select(by, "values", total(F.col("list")).alias("n_candidates"), text(F.col("list")).alias("candidates")))
    return reduce(DataFrame.unionByName, out).select(by, F.explode("values").alias("value"), "n_candidates", "candidates")


#: Sources that answer a kind of reference: fixed values. Other kinds have none.
KIND_SOURCES = {"technique": "mitre", "tactic": "mitre", "group": "mitre", "software": "mitre", "mitigation": "mitre", "data_source": "mitre", "ecs_field": "ecs", "sigma_rule": "sigma", "elastic_rule": "elastic"}


def resolved_by_kind(refs: DataFrame, index: DataFrame, value: str = "value", order: str = "ordinal", record: str = "id") -> DataFrame:
    """``resolved``, where only records of the source that answers a reference's ``kind`` are candidates; with ``note``.

    ``index`` has ``source``, which comes first in a set's id. A kind that no source answers, or whose source isn't in the index, is unresolved.
    """
    asked = F.lit(None).cast("string")
    for kind, source in KIND_SOURCES.items():
        asked = F.when(F.col("kind") == kind, source).otherwise(asked)
    there = index.select("source").distinct().select(F.col("source").alias("asked"), F.lit(True).alias("loaded"))
    rows = refs.withColumn("asked", asked)
    out = settled_keys(keyed(rows, value, "asked"), sets_of(index, order, record, "source")).join(F.broadcast(there), "asked", "left")  # a row for each source
    n = F.col("n_candidates")
    note = F.when(~F.coalesce("loaded", F.lit(False)), "no source at hand answers this kind").when(n == 0, "no record has this identifier").when(n > 1, F.format_string("%d records have this identifier", n))
    return out.withColumn("note", note).drop("loaded", "asked")


def resolution_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
