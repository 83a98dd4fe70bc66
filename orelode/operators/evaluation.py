"""Graded relevance from rules over records, runs of modes and ablations, and what a report derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V


def citations(references: DataFrame) -> DataFrame:
    """``identifier, record_id, source``: records by the upper-cased identifier that they cite, each once."""
    return references.select(F.upper(stripped("value")).alias("identifier"), "record_id", "source").filter("identifier <> ''").distinct()


def technique_truth(cases: DataFrame, defined: DataFrame, cited: DataFrame) -> DataFrame:
    """Grades (case_id, record_id, grade) for cases (case_id, ordinal, anchor): 3 defines it, 2 cites it, 1 defines its parent.

    The first grade of a record in the order of anchors and of these rules counts.
    """
    key = F.upper(stripped("anchor"))
    asked = cases.select("case_id", "ordinal", key.alias("identifier"))
    own = asked.join(defined, "identifier").select("case_id", "ordinal", F.lit(1).alias("rule"), "record_id", F.lit(3).alias("grade"))
    citing = asked.join(cited.select("identifier", "record_id"), "identifier").select("case_id", "ordinal", F.lit(2).alias("rule"), "record_id", F.lit(2).alias("grade"))
    parents = asked.filter(F.col("identifier").contains(".")).withColumn("identifier", F.substring_index("identifier", ".", 1)).join(defined, "identifier").select("case_id", "ordinal", F.lit(3).alias("rule"), "record_id", F.lit(1).alias("grade"))
    return own.unionByName(citing).unionByName(parents).groupBy("case_id", "record_id").agg(F.min_by("grade", F.struct("ordinal", "rule")).alias("grade"))


def ungrounded(cases: DataFrame, truth: DataFrame) -> DataFrame:
    """Cases without any relevant record."""
    return cases.select("case_id").distinct().join(truth.select("case_id").distinct(), "case_id", "left_anti")


def ablations(parts: DataFrame, dropped: tuple[str, ...] = ("lexical", "graph", "distance", "source", "section")) -> DataFrame:
    """Totals of scored candidates under the full weights and with each of these set to zero: ``variant, total``.

    The candidates are computed once; variants are columns of one row that are stacked.
    """
    def total(without: str | None):
        return F.round(sum((F.lit(w) * F.col(f"score_{k}") for k, w in V.WEIGHTS.items() if k != without), F.lit(0.0)), 6)

    variants = [F.struct(F.lit(name or "full").alias("variant"), total(name).alias("variant_total")) for name in (None, *dropped)]
    return parts.select("*", F.inline(F.array(*variants)))


def best_mode(means: DataFrame, value: str) -> DataFrame:
    """The mode of the highest value (ties by name), and each mode's distance to it."""
    top = means.agg(F.max(value).alias("top"), F.max_by("mode", F.struct(value)).alias("any"))
    return means.crossJoin(F.broadcast(top)).select("mode", value, F.round(F.col(value) - F.col("top"), 6).alias("delta"), (F.row_number().over(Window.orderBy(F.desc(value), "mode")) == 1).alias("best"))


def first_misses(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """Cases whose first record isn't relevant."""
    first = ranking.filter("position = 1").select("case_id", "record_id")
    return first.join(judgments.filter("grade > 0").select("case_id", "record_id"), ["case_id", "record_id"], "left_anti")
