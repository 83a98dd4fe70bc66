"""Requests and their replies as relations: rules of a request, stamps, flattened results, supplied material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import one_space, stripped
from orelode.operators.entities import nested_values
from orelode.operators.rule_parsing import strings

OPERATIONS = ("analyze", "enhance", "generate")


def request_faults(requests: DataFrame) -> DataFrame:
    """``request_id, fault`` of requests (request_id, operation, rule_text, query, language, requirement)."""
    said = lambda c: stripped(F.coalesce(c, F.lit(""))) != ""
    subjects = said("rule_text").cast("int") + said("query").cast("int") + said("requirement").cast("int")
    faults = F.array(
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "unknown operation"),
        F.when(subjects != 1, "exactly one subject is needed"),
        F.when((F.col("operation") == "generate") & ~said("requirement"), "generate needs a requirement"),
        F.when(F.col("operation").isin("analyze", "enhance") & said("requirement"), "a rule is needed"),
        F.when(said("language") & ~said("query"), "a language goes with a bare query only"),
        F.when(said("query") & ~said("language"), "a bare query needs its language"),
    )
    return requests.select("request_id", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


def stamp(started: Column, ended: Column) -> list[Column]:
    """An id, the end in UTC with milliseconds cut off, and the milliseconds taken (not below zero)."""
    millis = F.unix_millis(ended)
    at = F.date_format(F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return [F.uuid().alias("result_id"), at.alias("generated_at"), F.greatest(F.lit(0), millis - F.unix_millis(started)).alias("elapsed_ms")]


def flattened(replies: DataFrame, text: str = "reply") -> DataFrame:
    """``request_id, path, value`` of each scalar of a reply, in document order (``n``)."""
    rows = nested_values(replies.select(F.col("request_id").cast("string").alias("request_id"), F.col(text).alias("detection")))
    return rows.select("request_id", "n", F.regexp_replace("location", "^detection", "\\$").alias("path"), "field", "value")


def citations(replies: DataFrame, text: str = "reply") -> DataFrame:
    """``request_id, path, item_id`` of what replies cite under ``evidence``."""
    doc = F.try_parse_json(text)
    return replies.select(F.col("request_id").cast("string").alias("reply_id"), F.posexplode(strings(doc, "evidence")).alias("n", "item_id")).select("reply_id", F.format_string("$.evidence[%d]", "n").alias("path"), "item_id")


def supplied(items: DataFrame, rules: DataFrame) -> DataFrame:
    """``package_id, material, folded``: all that a reply may rest on, as it is and with case and white space folded."""
    parts = items.select("package_id", "place", F.concat_ws("\n", "item_id", "text").alias("part")).unionByName(rules.select("package_id", F.lit(-1).alias("place"), F.col("text").alias("part")))
    out = parts.groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n").alias("material"))
    return out.withColumn("folded", F.lower(one_space(F.col("material"))))
