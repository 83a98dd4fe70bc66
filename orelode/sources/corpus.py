"""The corpus of JSON lines: one file for each source, a checked envelope, and lookups.

Line numbers count blank lines, which hold no record. A line that breaks the envelope is an error that names its line.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.session import settled

SOURCES = ("mitre", "sigma", "elastic", "lolbas", "ecs")


def layout(root: str, sources: tuple[str, ...] = SOURCES) -> dict[str, str]:
    return {s: f"{root.rstrip('/')}/{s}/{s}.jsonl" for s in sources}


def available(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Sources whose file is there, and those whose file isn't, in order."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    there = []
    for source, path in layout(root).items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            there.append(source)
    return there, [s for s in SOURCES if s not in there]


def lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``source, line_number, line`` of a file's lines that aren't blank; numbers count blank lines, from 1.

    A large file is read by many tasks, each a stretch of it: a line's number is its place in its stretch after the lines
    of the stretches before, which are counted first (a row for each stretch).
    """
    rows = placed(spark, path).select(F.lit(source).alias("source"), F.col("n").cast("int").alias("line_number"), F.regexp_replace("value", "\r$", "").alias("line"))
    return rows.filter(stripped("line") != "")


def placed(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, n, value``: every line of a file as it is, with its number from 1."""
    of = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.monotonically_increasing_id().alias("at"), of["file_path"].alias("file"), of["file_size"].alias("size"), of["file_block_start"].alias("stretch"))
    counted = rows.groupBy("file", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counted.select("file", "stretch", "first", before.alias("before"))
    return rows.join(stretches, ["file", "stretch"]).select("file", "size", (F.col("at") - F.col("first") + F.col("before") + 1).alias("n"), "value")


def fault(line: Column) -> Column:
    """What is wrong with a line's envelope, or null."""
    value = F.try_parse_json(line)
    kind = lambda key: F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant"))
    out = F.when(value.isNull(), "not valid JSON").when(~F.schema_of_variant(value).startswith("OBJECT"), "not a JSON object")
    for key in ("id", "sourceId", "text", "metadata"):
        out = out.when(F.try_variant_get(value, f"$.{key}", "variant").isNull(), f"missing key {key}")
    for key in ("id", "sourceId", "text"):
        out = out.when(kind(key) != "STRING", f"{key} must be a string")
    return out.when(~kind("metadata").startswith("OBJECT"), "metadata must be an object")


def parsed(rows: DataFrame, strict: bool = True) -> DataFrame:
    """``source, line_number, id, source_id, text, metadata`` (a variant) of lines.

    Strict: the first broken line is an error. Else broken lines come with ``fault`` set, and null in the other columns.
    """
    bad = fault(F.col("line"))
    rows = rows.withColumn("fault", bad)
    if strict:
        rows = rows.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.format_string("%s line %d: %s", "source", "line_number", "fault"))))
    value = F.when(F.col("fault").isNull(), F.try_parse_json("line"))
    get = lambda key: F.try_variant_get(value, f"$.{key}", "string")
    return rows.select("source", "line_number", get("id").alias("id"), get("sourceId").alias("source_id"), get("text").alias("text"), F.try_variant_get(value, "$.metadata", "variant").alias("metadata"), "fault")


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """All records of the sources that are there."""
    out = None
    for source in available(spark, root)[0]:
        rows = parsed(lines(spark, layout(root)[source], source)).drop("fault")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "source string, line_number int, id string, source_id string, text string, metadata variant")


def source_order(source: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), source)


def ordered(records: DataFrame) -> DataFrame:
    """All records with ``source_ord``, source by source in their order and by line within one."""
    return records.withColumn("source_ord", source_order(F.col("source")) - 1).orderBy("source_ord", "line_number")


def by_source_id(records: DataFrame, asked: DataFrame) -> DataFrame:
    """All records of source ids (``source_id`` and, where given, ``source``), with ``nth``, their place in the file's order.

    An id that several records share gives all of them.
    """
    keys = [c for c in ("source", "source_id") if c in asked.columns]
    found = records.join(asked.select(*keys).distinct(), keys, "left_semi")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("source", "source_id").orderBy("line_number")))


def by_id(records: DataFrame, asked: DataFrame) -> DataFrame:
    """The first record of each id (``id``) within a source."""
    return first_records(records.join(asked.select("id").distinct(), "id", "left_semi"))


def repeated_ids(records: DataFrame) -> DataFrame:
    """``source, ordinal, id, n`` of ids that come more than once, in the order in which they are first seen."""
    many = records.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first")).filter("n > 1")
    return many.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("first"))).select("source", "ordinal", "id", "n")


def first_records(records: DataFrame) -> DataFrame:
    """The first record of each id within its source."""
    nth = F.row_number().over(Window.partitionBy("source", "id").orderBy("line_number"))
    return records.withColumn("nth", nth).filter("nth = 1").drop("nth")


def counts(records: DataFrame) -> DataFrame:
    """Records, distinct ids and ids that come twice, for each source."""
    per = records.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("repeated"))


class CorpusChangedError(Exception):
    """The corpus isn't what it was when a run began."""


def unchanged(before: dict[str, str], after: dict[str, str]) -> None:
    """An error that names the sources whose file changed, came or went."""
    if changed := sorted(s for s in before.keys() | after.keys() if before.get(s) != after.get(s)):
        raise CorpusChangedError(", ".join(changed))


def guarded_run(spark: SparkSession, root: str, run):
    """What ``run()`` returns, if the corpus is the same before and after it."""
    before = digests(spark, root)
    out = run()
    unchanged(before, digests(spark, root))
    return out


#: Lines of a digest's leaf, and nodes of a node.
LEAF, FANOUT = 4096, 1024


def file_digest(spark: SparkSession, path: str, leaf: int = LEAF, fanout: int = FANOUT) -> str:
    """A tree digest of a file of lines: many tasks each hash a stretch, and no cell or task holds the whole.

    Lines are hashed, ``leaf`` of them in order to a leaf, ``fanout`` nodes to a node, until one is left; the file's
    bytes and lines are hashed with it, so a last line's end counts too. How the file is split changes nothing.
    """
    rows = placed(spark, path).select("size", "n", F.sha2(F.col("value").cast("binary"), 256).alias("h"))
    above = lambda nodes, at: nodes.groupBy(at.alias("i")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("n"), F.col("h")))), lambda x: x["h"]), ""), 256).alias("h")).withColumnRenamed("i", "n")
    lines_, size = rows.agg(F.count(F.lit(1)), F.max("size")).first()
    if not lines_:
        return hashlib.sha256(b"0:0:").hexdigest()
    nodes, left = above(rows, F.floor((F.col("n") - 1) / leaf)), -(-lines_ // leaf)
    while left > 1:
        nodes, left = above(settled(nodes), F.floor(F.col("n") / fanout)), -(-left // fanout)
    return hashlib.sha256(f"{size}:{lines_}:{nodes.first().h}".encode()).hexdigest()


def digests(spark: SparkSession, root: str) -> dict[str, str]:
    """A digest of each source's file; a run compares them before and after."""
    there, _ = available(spark, root)
    return {s: file_digest(spark, layout(root)[s]) for s in there}
