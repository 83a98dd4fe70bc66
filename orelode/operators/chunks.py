"""Bounded chunks of records, with sections.

A record of at most ``limit`` characters is one chunk. A longer one is cut at the label lines it has, labels of one
section that follow each other are joined, and stretches that are too long become overlapping windows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.session import arrow_task

LIMIT, LEAST, OVERLAP = 2000, 40, 100
#: A label line, and the sections of known labels: fixed values.
LABEL = re.compile(r"^([A-Z][A-Za-z0-9 /&()'\-]{1,40}):[ \t]*.*$", re.MULTILINE)
SECTIONS = {
    "description": "description", "detection": "detection", "detection logic": "detection", "detection rules": "detection",
    "condition": "condition", "query": "query", "code": "command", "command": "command", "commands": "command",
    "usecase": "usage", "use case": "usage", "usage": "usage", "normalize": "usage", "example": "usage",
    "false positives": "false_positives", "falsepositives": "false_positives", "known false positives": "false_positives",
    "tags": "tags", "references": "references", "reference": "references", "url": "references",
    "platform": "platforms", "platforms": "platforms", "operating system": "platforms", "domain": "platforms",
    "parent technique": "relationships", "sub-technique": "relationships", "tactic(s)": "relationships", "mitre attack": "relationships", "attack technique": "relationships", "threat mapping": "relationships",
    "field": "field", "field set": "field", "type": "field", "binary": "field",
    "log source": "metadata", "status": "metadata", "level": "metadata", "severity": "metadata", "author": "metadata", "rule": "metadata", "sigma rule id": "metadata", "capability": "metadata", "index": "metadata",
}
DEFAULT_SECTION = {"mitre": "description", "sigma": "summary", "elastic": "summary", "lolbas": "summary", "ecs": "field"}
SEGMENT = "array<struct<section:string,label:string,start:int,end:int>>"
SEGMENT_TYPE = pa.list_(pa.struct([("section", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def segments(text: str, default: str, limit: int, least: int) -> list[dict]:
    """Sections of a text by where they start and end."""
    found = [(m.start(), SECTIONS[m[1].strip().lower()], m[1].strip()) for m in LABEL.finditer(text) if m[1].strip().lower() in SECTIONS] if len(text) > limit else []
    if not found:
        return [{"section": default, "label": "record", "start": 0, "end": len(text)}]
    out = [{"section": "summary", "label": "header", "start": 0, "end": found[0][0]}] if found[0][0] else []
    for (start, section, label), end in zip(found, [*(f[0] for f in found[1:]), len(text)], strict=True):
        if out and len(text[start:end].strip()) < least:
            out[-1]["end"] = end
        else:
            out.append({"section": section, "label": label, "start": start, "end": end})
    joined: list[dict] = []
    for s in out:
        if joined and joined[-1]["section"] == s["section"]:
            joined[-1]["end"] = s["end"]
        else:
            joined.append(s)
    return joined


def segment_batches(batches, limit: int, least: int):
    for batch in batches:
        got = [segments(t, d, limit, least) for t, d in zip(batch.column("text").to_pylist(), batch.column("section").to_pylist(), strict=True)]
        yield batch.append_column("segments", pa.array(got, SEGMENT_TYPE))


def sectioned(records: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """``records`` (id, source, text) with their array of segments."""
    rows = records.select("id", "source", F.coalesce("text", F.lit("")).alias("text"), default_section(F.col("source")).alias("section"))
    return rows.mapInArrow(arrow_task(__name__, "segment_batches", limit=limit, least=least), f"id string, source string, text string, section string, segments {SEGMENT}").drop("section")


def default_section(source: Column) -> Column:
    out = F.lit("summary")
    for name, section in DEFAULT_SECTION.items():
        out = F.when(source == name, section).otherwise(out)
    return out


def window_starts(length: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Where the windows over a stretch of this length start."""
    stride = max(1, limit - min(overlap, limit - 1))
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - limit) / stride)).cast("int") * stride, F.lit(stride))


def chunked(records: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of records (id, source, text), their ids counted by section within the record."""
    parts = sectioned(records, limit, least).select("id", "source", "text", F.posexplode("segments").alias("n", "s"))
    parts = parts.withColumn("starts", window_starts(F.col("s.end") - F.col("s.start"), limit, overlap))
    parts = parts.select("id", "source", "text", "n", "s", F.size("starts").alias("part_count"), F.posexplode("starts").alias("part", "at"))
    start, end = F.col("s.start") + F.col("at"), F.least(F.col("s.end"), F.col("s.start") + F.col("at") + limit)
    order = F.row_number().over(_of("id", "section").orderBy("n", "part"))
    rows = parts.select(F.col("id").alias("record_id"), "source", F.col("s.section").alias("section"), F.col("s.label").alias("label"), "n", "part", "part_count", start.alias("char_start"), end.alias("char_end"), F.substring("text", start + 1, end - start).alias("text"), F.col("id"))
    return rows.withColumn("ordinal", order).select(F.format_string("%s:%s:%03d", "record_id", "section", "ordinal").alias("chunk_id"), "record_id", "source", "section", "label", (F.col("part") + 1).alias("part"), "part_count", "char_start", "char_end", "text")


def windows(records: DataFrame, section: str = "summary", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of records without labels: native from the scan on, and without a shuffle."""
    starts = window_starts(F.length("text"), limit, overlap)
    rows = records.select("id", "source", "text", F.size(starts).alias("part_count"), F.posexplode(starts).alias("part", "at"))
    return rows.select(F.format_string("%s:%s:%03d", "id", F.lit(section), F.col("part") + 1).alias("chunk_id"), F.col("id").alias("record_id"), "source", F.lit(section).alias("section"), (F.col("part") + 1).alias("part"), "part_count", F.col("at").alias("char_start"), F.least(F.length("text"), F.col("at") + limit).alias("char_end"), F.substring("text", F.col("at") + 1, F.lit(limit)).alias("text"))


def _of(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def problems(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(code, chunk_id) of chunks that break a rule."""
    repeated = chunks.groupBy("chunk_id").count().filter("count > 1").select(F.lit("duplicate_id").alias("code"), "chunk_id")
    checks = {"missing_parent": "record_id IS NULL OR record_id = ''", "foreign_id": "NOT startswith(chunk_id, concat(record_id, ':'))", "too_long": f"length(text) > {limit}"}
    if lost := [c for c in ("source", "source_id", "location") if c in chunks.columns]:
        checks["missing_provenance"] = " OR ".join(f"coalesce({c}, '') = ''" for c in lost)
    codes = F.filter(F.array(*[F.when(F.expr(c), k) for k, c in checks.items()]), lambda x: x.isNotNull())
    return chunks.select(F.explode(codes).alias("code"), "chunk_id").unionByName(repeated)
