"""Merging of text and graph evidence, weighted scores, ranks, and the tie rule of field records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V

SATURATION, DECAY = 12.0, 0.6
EVIDENCE = "array<struct<route_ord:int,method:string,match_kind:string,raw_score:double,hops:int,matched:array<string>>>"


def evidence(method: str, match_kind: Column, raw_score: Column, hops: Column, matched: Column) -> Column:
    return F.struct(F.lit(0 if method == "text" else 1).alias("route_ord"), F.lit(method).alias("method"), match_kind.alias("match_kind"), raw_score.cast("double").alias("raw_score"), hops.cast("int").alias("hops"), matched.alias("matched"))


def merged(text: DataFrame, graph: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, evidence) by chunk, the text route's evidence first."""
    both = text.select("query_id", "chunk_id", "evidence").unionByName(graph.select("query_id", "chunk_id", "evidence"))
    return both.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list("evidence")).alias("evidence"))


def weight(table: dict[str, float], of: Column, default: float) -> Column:
    out = F.lit(default)
    for name, w in table.items():
        out = F.when(of == name, w).otherwise(out)
    return out


def match_kind(hop: Column, seed: Column, identifiers: Column) -> Column:
    """How a graph candidate was met: a seed by one of its identifiers, a seed by its name, or a neighbour."""
    return F.when(hop > 0, "graph_neighbour").when(F.array_contains(identifiers, F.lower(stripped(seed))), "exact_identifier").otherwise("graph_seed")


def scored(candidates: DataFrame) -> DataFrame:
    """Adds the seven parts and ``total`` to candidates (evidence, source, section, identifiers, fields)."""
    e = F.col("evidence")
    has = lambda f: F.when(F.exists(e, f), 1.0).otherwise(0.0)
    wanted = F.transform(F.concat("identifiers", "fields"), lambda x: F.lower(stripped(x)))
    best = F.coalesce(F.array_max(F.transform(F.filter(e, lambda x: x.method == "text"), lambda x: x.raw_score)), F.lit(0.0))
    hops = F.array_min(F.transform(F.filter(e, lambda x: x.method == "graph"), lambda x: x.hops))
    source = F.when((F.col("source") == "ecs") & (F.size("fields") > 0), 1.0).otherwise(weight(V.SOURCE_WEIGHTS, F.col("source"), 0.5))
    parts = {
        "exact": has(lambda x: (x.match_kind == "exact_identifier") & (F.size(x.matched) > 0)),
        "entity": has(lambda x: F.arrays_overlap(F.transform(x.matched, lambda m: F.lower(stripped(m))), F.filter(F.col("wanted"), lambda w: w != ""))),
        "graph": has(lambda x: x.method == "graph"),
        "lexical": F.when(best > 0, best / (best + SATURATION)).otherwise(0.0),
        "source": source,
        "distance": F.coalesce(F.pow(F.lit(DECAY), hops), F.lit(0.0)),
        "section": weight(V.SECTION_WEIGHTS, F.col("section"), 0.6),
    }
    rows = candidates.withColumn("wanted", wanted).select(*candidates.columns, *[v.alias(f"score_{k}") for k, v in parts.items()])
    total = sum((F.lit(w) * F.col(f"score_{k}") for k, w in V.WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("total", F.round(total, 6))


def ranked(rows: DataFrame, limit: int | None = None, ceiling: int = 200) -> DataFrame:
    """``rows`` by total, ties by chunk id, at most max(ceiling, limit) of them; then field records of one total change
    places among themselves by the first field the query named (``named_at``, null if none), and ``limit`` are kept.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "chunk_id")
    rows = rows.withColumn("slot", F.row_number().over(best))
    if limit is not None:
        rows = rows.filter(F.col("slot") <= max(ceiling, limit))
    tied = Window.partitionBy("query_id", "total", F.col("source") == "ecs")
    rows = rows.withColumn("place", F.row_number().over(tied.orderBy("slot"))).withColumn("member", F.row_number().over(tied.orderBy(F.coalesce("named_at", F.lit(1 << 30)), "chunk_id")))
    moves = (F.col("source") == "ecs") & (F.size("fields") > 0)
    slots = rows.select("query_id", "total", F.col("source").alias("of_source"), F.col("place").alias("member"), F.col("slot").alias("rank")).filter("of_source = 'ecs'").drop("of_source")
    moved = rows.filter(moves).join(slots, ["query_id", "total", "member"])
    out = rows.filter(~moves).withColumn("rank", F.col("slot")).unionByName(moved.select(*rows.columns, "rank"))
    out = out.drop("slot", "place", "member")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def statistics(rows: DataFrame) -> DataFrame:
    """Counters of each query's merged candidates."""
    by = lambda m: F.exists("evidence", lambda x: x.method == m)
    return rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(by("text")).alias("by_text"), F.count_if(by("graph")).alias("by_graph"), F.count_if(by("text") & by("graph")).alias("by_both"),
        F.coalesce(F.max(F.array_max(F.transform("evidence", lambda x: x.hops))), F.lit(0)).alias("max_hops"),
    )


def problems(results: DataFrame, known: DataFrame) -> DataFrame:
    """(code, query_id, chunk_id): unknown chunks, no evidence, scores out of [0, 1], and ranks not in order of scores."""
    unknown = results.join(known.select("chunk_id").distinct(), "chunk_id", "left_anti").select(F.lit("unknown_chunk").alias("code"), "query_id", "chunk_id")
    above = results.withColumn("above", F.lag("total").over(Window.partitionBy("query_id").orderBy("rank")))
    codes = F.filter(F.array(F.when(F.size("evidence") == 0, "no_evidence"), F.when((F.col("total") < 0) | (F.col("total") > 1), "score_range"), F.when(F.col("total") > F.col("above"), "not_descending")), lambda c: c.isNotNull())
    return unknown.unionByName(above.select(F.explode(codes).alias("code"), "query_id", "chunk_id"))
