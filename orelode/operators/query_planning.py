"""What a rule asks the corpus: its text, identifiers that records can have, and its fields in two spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import first_seen, stripped
from orelode.operators import vocabulary as V

#: Canonical types whose identifier names a record: fixed values.
CORPUS_KEYED = ("attack_technique_reference", "attack_tactic_reference", "attack_group_reference", "attack_software_reference", "cve_reference")
FIELD_TYPES = ("field",)


def documented_fields(records: DataFrame, field: str = "field_name") -> DataFrame:
    """Names of fields that the corpus documents, trimmed and lower-cased, each once."""
    return records.select(F.lower(stripped(F.col(field))).alias("documented")).filter("documented <> ''").distinct()


def rule_queries(entities: DataFrame, documented: DataFrame) -> DataFrame:
    """``rule_id, entity_ids, canonical_fields, lexical_fields`` of mapped entities (rule_id, ordinal, entity_type, value, mapped).

    A field counts if it was resolved, or if the corpus documents it by its own name. It is asked for in the corpus's
    spelling where a rename leads to a documented name, and as the rule wrote it. All lists are in first-seen order.
    """
    spark = entities.sparkSession
    renames = F.broadcast(spark.createDataFrame(list(V.RENAMES.items()), "key string, renamed string"))  # a fixed table
    m, resolved = F.col("mapped"), F.col("mapped.status") != "unresolved"
    rows = entities.withColumn("name", F.when(F.col("entity_type").isin(*FIELD_TYPES), F.coalesce(m["canonical_value"], F.col("value")))).withColumn("key", F.lower(stripped("name")))
    known = documented.withColumn("is_documented", F.lit(True))
    rows = rows.join(renames, "key", "left").join(known.withColumnRenamed("documented", "key"), "key", "left")
    rows = rows.join(known.select(F.col("documented").alias("renamed"), F.col("is_documented").alias("rename_documented")), "renamed", "left")
    asks = F.col("name").isNotNull() & (resolved | F.coalesce("is_documented", F.lit(False)))
    listed = lambda when, value: first_seen(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ordinal", value.alias("v"))))), lambda x: x["v"]))
    return rows.groupBy("rule_id").agg(
        listed(resolved & m["canonical_type"].isin(*CORPUS_KEYED) & m["canonical_id"].isNotNull(), m["canonical_id"]).alias("entity_ids"),
        listed(asks, F.when(F.coalesce("rename_documented", F.lit(False)), F.col("renamed")).otherwise(F.col("name"))).alias("canonical_fields"),
        listed(asks, F.col("name")).alias("lexical_fields"),
    )
