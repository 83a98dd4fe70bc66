"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A part file is a row of records. Each is framed as

    length       unsigned 64-bit, little-endian
    masked crc   of these eight bytes, unsigned 32-bit
    payload      doc_id (signed 64-bit, its own flag byte first), then the ids, unsigned 16- or 32-bit as the file says
    masked crc   of the payload

A mask keeps checksums of data that hold checksums apart: the crc is turned right by 15 bits and a constant is added.
The index of a part holds, for each record, the byte offset of its frame, unsigned 64-bit, and ends with the file's
size. Tasks write under a name of their own and rename at the end, so a repeated task replaces what a lost one left.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm.runtime import Sink, column, passing, record, scratch, task, values
from orelode.llm.tokens import encoder, unpack

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<Bq")
MANIFEST = pa.schema([("part", pa.int32()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(f) -> bytes | None:
    """The next record's payload; None at the end."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("the file ends inside a record")
    size, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("a record's length is damaged")
    payload = f.read(size)
    tail = f.read(4)
    if len(payload) < size or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("a record is damaged")
    return payload


#: What Spark calls a store, where Arrow has another name for it.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme and host that Spark resolves it to, so that executors go where the driver does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return path.getFileSystem(conf).makeQualified(path).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A qualified folder's store and the path there; any store that Arrow has (local or mounted, s3, gs, abfss, hdfs)."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        raise ValueError(f"{uri} isn't qualified: executors can't know which store it is in")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def is_wide(path: str, end: int | None = None) -> bool:
    """Whether ids of this vocabulary (and the end id) need 32 bits."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    return max([end or 0, *made["model"]["vocab"].values(), *(t["id"] for t in made["added_tokens"])]) > 0xFFFF


def name(part: int, kind: str) -> str:
    return f"part-{part:06d}.{kind}"


def write_part(batches, path: str, folder: str, end: int | None, wide: bool):
    """Encodes a partition's texts and writes its two files."""
    part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
    most = 0xFFFFFFFF if wide else 0xFFFF
    store, top = opened(folder)
    enc, offsets, at, n_ids = None, [], 0, 0
    kind, tail = ("<u4" if wide else "<u2"), b"" if end is None else end.to_bytes(4, "little")
    rows = (r for b in batches for r in zip(column(b, "doc_id"), values(b, "text"), strict=True))
    if (first := next(rows, None)) is None:
        return
    enc = encoder(path)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/.{own}.rec") as f:
        row = first
        while row is not None:
            doc, text = row
            ids = unpack(enc.encode(text or "") + tail)
            if len(ids) and int(ids.max()) > most:
                raise ValueError(f"id {int(ids.max())} doesn't fit the records' width")
            made = frame(KEY.pack(doc is not None, doc or 0) + ids.astype(kind).tobytes())
            f.write(made)
            offsets.append(at)
            at += len(made)
            n_ids += len(ids)
            row = next(rows, None)
    with store.open_output_stream(f"{top}/.{own}.idx") as f:
        f.write(np.array([*offsets, at], "<u8").tobytes())
    for k in ("idx", "rec"):
        store.move(f"{top}/.{own}.{k}", f"{top}/{name(part, k)}")
    yield record(MANIFEST, part=[part], n_records=[len(offsets)], n_ids=[n_ids])


def payload_ids(payload: bytes, wide: bool) -> tuple[int | None, np.ndarray]:
    there, doc = KEY.unpack_from(payload)
    return doc if there else None, np.frombuffer(payload, "<u4" if wide else "<u2", offset=KEY.size)


def read_parts(batches, folder: str, wide: bool):
    """Streams the records of each part; starts count on from ``base``."""
    store, top = opened(folder)
    sink = Sink(RECORDS)
    for batch in batches:
        for row in batch.to_pylist():
            start = row["base"]
            with store.open_input_stream(f"{top}/{name(row['part'], 'rec')}", buffer_size=1 << 20) as f:
                while (payload := unframe(f)) is not None:
                    doc, ids = payload_ids(payload, wide)
                    if sink.add((doc, start, ids.astype("<u4").tobytes()), 4 * len(ids) + 64):
                        yield from sink.flush()
                    start += len(ids)
    yield from sink.flush()


def read_record(folder: str, part: int, k: int, wide: bool = False) -> tuple[int | None, np.ndarray]:
    """The k-th record of a part of a qualified folder by its index: two seeks, for reads in any order."""
    store, top = opened(folder)
    with store.open_input_file(f"{top}/{name(part, 'idx')}") as f:
        f.seek(8 * k)
        at, to = np.frombuffer(f.read(16), "<u8").tolist()
    with store.open_input_file(f"{top}/{name(part, 'rec')}") as f:
        f.seek(at)
        raw = f.read(to - at)
    return payload_ids(unframe(pa.BufferReader(raw)), wide)


def write_records(docs: DataFrame, path: str, folder: str, end: int | None = None, key: str = "doc_id", text: str = "text", wide: bool | None = None) -> list[tuple[int, int, int]]:
    """Writes the ids of all texts in ascending order of the key (nulls first, ties by text) as parts in ``folder``.

    Returns (part, records, ids) for each part: a few numbers for each partition. A null text counts as empty; repeated
    rows are records each; other columns go; an empty table gives no part. ``wide`` records hold ids of 32 bits; unless
    it is given, the vocabulary and the end id decide. An id that doesn't fit is an error.
    """
    wide, folder = is_wide(path, end) if wide is None else wide, qualified(docs.sparkSession, folder)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    made = dealt.mapInArrow(task(__name__, "write_part", path=path, folder=folder, end=end, wide=wide), "part int, n_records long, n_ids long").collect()
    return sorted(tuple(r) for r in made)


def read_records(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]], wide: bool = False) -> DataFrame:
    """``doc_id, start, ids`` of each record: ``start`` counts the ids of all records before, ``ids`` are packed (32-bit)."""
    base, rows = 0, []
    for part, _, n_ids in parts:
        rows.append((part, base))
        base += n_ids
    folder = qualified(spark, folder)
    listed = spark.createDataFrame(rows, "part int, base long").repartitionByRange(max(1, len(rows)), "part")
    return listed.mapInArrow(task(__name__, "read_parts", folder=folder, wide=wide), "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str, end: int | None = None) -> DataFrame:
    """Writes the records to a new shared folder and reads them back."""
    spark, folder, wide = docs.sparkSession, scratch(docs.sparkSession), is_wide(path, end)
    parts = write_records(docs, path, folder, end, wide=wide)
    passing(spark, folder)
    return read_records(spark, folder, parts, wide)
