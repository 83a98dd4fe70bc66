"""Rule documents as JSON text: JSON stays as it is, YAML is decoded in the workers."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.session import arrow_task


def decoded(text: str | None) -> tuple[str | None, str | None]:
    """(JSON text, fault) of a document."""
    text = (text or "").strip()
    if not text:
        return None, "empty document"
    try:
        if text[0] in "{[":
            made = json.loads(text)
        else:
            import yaml

            made = yaml.safe_load(text)
    except Exception as error:  # a broken document is a row with a fault
        return None, f"cannot be read: {type(error).__name__}"
    return (json.dumps(made, default=str), None) if isinstance(made, dict) else (None, "not a mapping")


def decode_batches(batches):
    for batch in batches:
        got = [decoded(t) for t in batch.column("raw").to_pylist()]
        yield batch.append_column("text", pa.array([a for a, _ in got], pa.string())).append_column("fault", pa.array([b for _, b in got], pa.string()))


def documents(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rule_id, raw, text, fault`` of rows (rule_id, raw)."""
    some = rows.select(F.col("rule_id").cast("string"), F.col(raw).alias("raw"))
    return some.mapInArrow(arrow_task(__name__, "decode_batches"), "rule_id string, raw string, text string, fault string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file."""
    return documents(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rule_id"), F.col("value").alias("raw")))
