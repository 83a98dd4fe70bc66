"""Evidence within a budget: redaction, order, cuts, and the checks of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_LIMIT, TOTAL_LIMIT, RESERVED, WARNING_LIMIT = 20_000, 60_000, 8_000, 20_000
MARKER = "\n[...truncated]"
#: Sections in their order: fixed values.
SECTIONS = ("rule", "entities", "mappings", "retrieval", "graph", "knowledge", "references", "warnings", "metadata")
#: Credentials that are masked, in order: fixed values.
CREDENTIALS = (
    ("assignment", r"(?i)\b(api[_-]?key|apikey|secret|password|passwd|token|bearer|authorization)\s*[:=]\s*[\"']?([A-Za-z0-9._\-/+]{8,})[\"']?", "$1=[REDACTED]"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED]"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b", "[REDACTED]"),
)


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``redacted`` and ``fired``, the patterns that matched what was left of the text at their turn."""
    out = rows.withColumns({"redacted": F.col(text), "fired": F.array().cast("array<string>")})
    for name, pattern, to in CREDENTIALS:
        hit = F.coalesce(F.col("redacted").rlike(pattern), F.lit(False))
        out = out.withColumn("fired", F.when(hit, F.array_append("fired", name)).otherwise(F.col("fired"))).withColumn("redacted", F.regexp_replace("redacted", pattern, to))
    return out


def organised(items: DataFrame) -> DataFrame:
    """Adds ``place``: sections in their order; retrieval and graph by priority, rank, score, hops and id, others as given (``ordinal``)."""
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    sorts = F.col("section").isin("retrieval", "graph")
    keys = [F.when(sorts, F.col("priority")), F.when(sorts, F.coalesce("rank", F.lit(1 << 30))), F.when(sorts, -F.coalesce("score", F.lit(-1.0))), F.when(sorts, F.coalesce("hops", F.lit(1 << 30))), F.when(sorts, F.lit(0)).otherwise(F.col("ordinal")), F.col("item_id")]
    return items.withColumn("section_ord", section).withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy("section_ord", *keys)))


POLICIES = ("none", "trim_tail", "drop_lowest")


def fitted(rows: DataFrame, group: tuple[str, ...], limit: int, policy: str = "trim_tail", size: str = "size") -> DataFrame:
    """``rows`` (place, and a size in characters) with ``kept``, what a limit leaves of each, earliest first.

    A group within its limit stays as it is. Else, by ``trim_tail``, the item that crosses the limit is cut, its marker
    within the room; one that has no room for more than the marker is dropped, and later ones that fit still come in. By
    ``drop_lowest`` all from the first that doesn't fit go, and by ``none`` a group over its limit is an error. A limit
    of zero or less is none. Sums run along the places; only what may still fit a room of less than a marker is folded.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} isn't known")
    of, n = Window.partitionBy(*group), F.col(size).cast("long")
    if limit <= 0:
        return rows.withColumn("kept", n)
    marker = len(MARKER)
    out = rows.withColumns({"upto": F.sum(n).over(of.orderBy("place")), "in_all": F.sum(n).over(of)})
    if policy == "none":
        over = F.raise_error(F.format_string(f"%d characters are more than the {limit} allowed", "in_all")).cast("long")
        return out.withColumn("kept", F.when(F.col("in_all") <= limit, n).otherwise(over)).drop("upto", "in_all")
    before = F.col("upto") - n
    crossing = (F.col("upto") > limit) & (before <= limit)
    out = out.withColumn("room", F.min(F.when(crossing, limit - before)).over(of)).withColumn("at", F.min(F.when(crossing, F.col("place"))).over(of))
    whole, first = F.col("upto") <= limit, F.col("place") == F.col("at")
    if policy == "drop_lowest":
        return out.withColumn("kept", F.when(whole, n).otherwise(F.lit(0).cast("long"))).drop("upto", "in_all", "room", "at")
    out = out.withColumn("kept", F.when(whole, n).when(first & (F.col("room") > marker), F.col("room").cast("long")).otherwise(F.lit(0).cast("long")))
    small = out.filter((F.col("place") > F.col("at")) & (F.col("room") <= marker) & (n <= F.col("room")) & (n > 0))
    start = F.struct(F.max("room").cast("long").alias("room"), F.array().cast("array<long>").alias("places"))

    def step(acc, item):  # at most as many come in as a marker has characters
        fits = item["n"] <= acc["room"]
        return F.struct(F.when(fits, acc["room"] - item["n"]).otherwise(acc["room"]).alias("room"), F.when(fits, F.array_append(acc["places"], item["place"])).otherwise(acc["places"]).alias("places"))

    listed = F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), n.alias("n"))))
    late = small.groupBy(*group).agg(F.aggregate(listed, start, step, lambda acc: acc["places"]).alias("late"))
    out = out.join(late, list(group), "left")
    return out.withColumn("kept", F.when(F.coalesce(F.array_contains("late", F.col("place").cast("long")), F.lit(False)), n).otherwise(F.col("kept"))).drop("upto", "in_all", "room", "at", "late")


def budgeted(items: DataFrame, section_limit: int = SECTION_LIMIT, total_limit: int = TOTAL_LIMIT - RESERVED, policy: str = "trim_tail") -> DataFrame:
    """``package_id, item_id, section, place, size, kept``: first each section within its limit, then all within the total."""
    rows = items.select("package_id", "item_id", "section", "place", F.length("text").cast("long").alias("size"))
    first = fitted(rows, ("package_id", "section"), section_limit, policy).withColumnRenamed("kept", "size1")
    return fitted(first, ("package_id",), total_limit, policy, "size1").select("package_id", "item_id", "section", "place", "size", "kept")


def cut_text(text: Column, size: Column, kept: Column) -> Column:
    return F.when(kept == size, text).when(kept > len(MARKER), F.concat(F.substring(text, F.lit(1), (kept - len(MARKER)).cast("int")), F.lit(MARKER)))


def collapsed(warnings: DataFrame) -> DataFrame:
    """Warnings of dropped items by package, detail and section: the first of each, with their number."""
    return warnings.groupBy("package_id", "detail", "section").agg(F.min("ordinal").alias("ordinal"), F.min_by("item_id", "ordinal").alias("item_id"), F.count(F.lit(1)).alias("n"))


def notice(n: Column, limit: int) -> Column:
    return F.format_string(f"%d more warning(s) came up and are left out: this section holds {limit} characters at most", n)


def within_ceiling(warnings: DataFrame, limit: int = WARNING_LIMIT) -> DataFrame:
    """The warnings (package_id, ordinal, text) before the first that would pass the limit, less room for a notice that
    counts all of them; where some are left out, a closing notice with their number, its ordinal after the last one's.
    """
    of = Window.partitionBy("package_id")
    rows = warnings.select("package_id", "ordinal", "text").withColumn("n", F.count(F.lit(1)).over(of)).withColumn("upto", F.sum(F.length("text")).over(of.orderBy("ordinal")))
    rows = rows.withColumn("fits", F.col("upto") <= limit - F.length(notice(F.col("n"), limit)))
    left = rows.groupBy("package_id").agg(F.count_if(~F.col("fits")).alias("left"), (F.max("ordinal") + 1).alias("ordinal")).filter(F.col("left") > 0)
    return rows.filter("fits").select("package_id", "ordinal", "text").unionByName(left.select("package_id", "ordinal", notice(F.col("left"), limit).alias("text")))


def section_texts(items: DataFrame) -> DataFrame:
    """Each section's items by place, parted by blank lines."""
    lists = F.array_sort(F.collect_list(F.struct("place", "text")))
    return items.filter("text IS NOT NULL").groupBy("package_id", "section").agg(F.array_join(F.transform(lists, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("items"))


def problems(items: DataFrame, total_limit: int = TOTAL_LIMIT - RESERVED, section_limit: int = SECTION_LIMIT, order: tuple[str, ...] = ("place", "item_id")) -> DataFrame:
    """(code, package_id, subject): budgets, ids that come twice, order of sections, marks of cut items, secrets.

    ``order`` is that of a package's items; it has to tell apart those that share a place.
    """
    rows = items.withColumn("section_ord", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")))
    per_section = rows.groupBy("package_id", "section").agg(F.sum(F.length("text")).alias("size")).filter(F.col("size") > section_limit).select(F.lit("section_over_budget").alias("code"), "package_id", F.col("section").alias("subject"))
    total = rows.groupBy("package_id").agg(F.sum(F.length("text")).alias("size")).filter(F.col("size") > total_limit).select(F.lit("over_budget").alias("code"), "package_id", F.lit("").alias("subject"))
    twice = rows.groupBy("package_id", "item_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate_item").alias("code"), "package_id", F.col("item_id").alias("subject"))
    before = rows.withColumn("before", F.lag("section_ord").over(Window.partitionBy("package_id").orderBy(*order)))
    secret = F.lit(False)
    for _, pattern, _ in CREDENTIALS:
        secret = secret | F.col("text").rlike(pattern)
    codes = F.filter(F.array(F.when(F.col("before") > F.col("section_ord"), "section_order"), F.when(F.col("truncated") & ~F.col("text").endswith(MARKER), "no_mark"), F.when(secret, "secret"), F.when(F.col("section_ord") == 0, "unknown_section")), lambda c: c.isNotNull())
    return per_section.unionByName(total).unionByName(twice).unionByName(before.select(F.explode(codes).alias("code"), "package_id", F.col("item_id").alias("subject")))


def evidence_items(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items of ranked results: those with a graph route go to ``graph``, others to ``retrieval``; priority by the score's parts."""
    graph = F.exists("evidence", lambda e: e.method == "graph")
    priority = F.when(F.col("score_exact") > 0, 0).when(F.col("score_graph") > 0, 1).when(F.col("score_entity") > 0, 2).otherwise(3)
    hops = F.array_min(F.transform(F.filter("evidence", lambda e: e.method == "graph"), lambda e: e.hops))
    rows = results.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    section = F.when(graph, "graph").otherwise("retrieval")
    return rows.select(F.col("query_id").alias("package_id"), F.format_string("%s:%04d", section, "rank").alias("item_id"), section.alias("section"), F.col("rank").alias("ordinal"), priority.alias("priority"), "rank", F.col("total").alias("score"), hops.alias("hops"), F.col("chunk_text").alias("text"), F.col("chunk_id").alias("provenance"))


def seed_warnings(reports: DataFrame) -> DataFrame:
    """(package_id, ordinal, code, detail) of seeds that aren't simply resolved."""
    detail = F.when(F.col("status") == "redirected", F.concat_ws(" ", "value", F.lit("is now"), "successor")).when(F.col("status") == "ambiguous", F.concat_ws(" ", "value", F.lit("names"), F.concat_ws(", ", "node_ids"))).otherwise(F.concat_ws(" ", "value", F.lit("is not in the corpus")))
    return reports.filter("status <> 'resolved'").select(F.col("query_id").alias("package_id"), "ordinal", F.concat(F.col("status"), F.lit("_seed")).alias("code"), detail.alias("detail"))


def package_metadata(items: DataFrame) -> DataFrame:
    """Items, characters and distinct sources in the order of places, for each package and section."""
    first = items.groupBy("package_id", "section").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("characters"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "provenance"))), lambda x: x["provenance"])).alias("sources"))
    return first.withColumn("section_ord", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")))


def packaged(items: DataFrame, section_limit: int = SECTION_LIMIT, total_limit: int = TOTAL_LIMIT - RESERVED, policy: str = "trim_tail") -> DataFrame:
    """Items redacted, in order, and cut to the budget; those without room are gone."""
    clean = organised(redacted(items).drop("text").withColumnRenamed("redacted", "text"))
    kept = budgeted(clean, section_limit, total_limit, policy).select("package_id", "item_id", "size", "kept")
    out = clean.join(kept, ["package_id", "item_id"]).withColumn("truncated", (F.col("kept") > 0) & (F.col("kept") < F.col("size"))).withColumn("text", cut_text(F.col("text"), F.col("size"), F.col("kept")))
    return out.filter("text IS NOT NULL")
