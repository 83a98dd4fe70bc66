"""Rules as they arrive: the stateless operators over a stream of files, in the batch operators' own code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.operators.rule_parsing import parsed


def rule_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Parsed rules of a folder's JSON documents, one to a file."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).option("wholetext", True).text(path)
    return parsed(raw.select(F.col("value").alias("text")))


def kinds_by_window(events: DataFrame, time: str, kind: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and kind; rows that come later than the watermark allows are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("window"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
