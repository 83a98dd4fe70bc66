"""What the operators share: tasks in Python workers, written tables, and Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back, where others keep them
ROOT = str(Path(__file__).resolve().parents[2])


BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bytes_of(size: str) -> int:
    """A size setting in bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", size.lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def task(module: str, function: str, **settings) -> Callable:
    """A function for mapInArrow that imports ``module`` in the worker, so that what it caches lives until the worker
    goes on to another module's task.

    Lowers the session's bound on the bytes of an Arrow batch to ``BATCH``: whole texts vary so much in length that a
    bound on rows alone would not hold an executor's and a worker's memory.
    """
    root, spark = ROOT, SparkSession.getActiveSession()
    if spark is not None and not 0 < bytes_of(spark.conf.get(BATCH_KEY, "64m")) <= BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        from orelode.llm.runtime import give_back, let_go, trimmed

        let_go(module)
        yield from getattr(importlib.import_module(module), function)(trimmed(batches), **settings)
        give_back()

    return run


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder of ``spark.checkpoint.dir``; without that setting in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/orelode-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a table in the shared folder: later reads need none of the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.options(**options).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(p)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from ``written``."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case, near the wanted ones."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def blank(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def values(batch: pa.RecordBatch, name: str) -> Iterator:
    """A column's values one by one, for long texts."""
    return (v.as_py() for v in batch.column(name))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each one, freed memory goes back to the system."""
    for batch in batches:
        yield batch
        del batch
        give_back()


#: What the worker's last task was of.
_last = {"module": ""}


def let_go(module: str) -> None:
    """Drops the encoders of another operator's tasks (or another part's): workers outlive them, and each would hold its vocabulary and cache on."""
    if module != _last["module"]:
        _last["module"] = module
        holders = [m for n in ("tokens", "token_counts") if (m := sys.modules.get(f"orelode.llm.{n}")) and m._kept]
        for holder in holders:
            holder._kept.clear()
        if holders:
            gc.collect()  # an encoder and its cache know each other
            give_back()


def give_back() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


class Sink:
    """Rows gathered into batches of bounded bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 8 << 20):
        self.schema, self.limit, self.rows, self.size = schema, limit, [], 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """Whether it is time to flush."""
        self.rows.append(row)
        self.size += size
        return self.size >= self.limit

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = list(zip(*self.rows, strict=True))
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)
