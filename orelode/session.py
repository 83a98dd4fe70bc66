"""Sessions, and functions that run in Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrow_task(module: str, function: str, **settings) -> Callable:
    """A function for mapInArrow that imports ``module`` in the worker."""
    root = str(Path(__file__).resolve().parents[1])

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), function)(batches, **settings)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(cores: int = 8, name: str = "orelode", **conf: str) -> SparkSession:
    """A local session with settings for one machine; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(cores), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its scan has fewer splits than there are; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else one under the warehouse.

    A cluster whose only folder would be each machine's own is an error: later reads would miss what other executors wrote.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if base.split(":", 1)[0] in ("file", base) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/scratch"


def passing(spark: SparkSession) -> str:
    """A new folder's path in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/orelode-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return path


def settled(df: DataFrame, **options) -> DataFrame:
    """``df`` computed once into a table in the shared folder, its lineage cut.

    Columns without a type hold nulls only and become strings.
    """
    spark = df.sparkSession
    df = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    path = f"{passing(spark)}/rows"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table from ``settled``; nothing may read it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = jvm.org.apache.hadoop.fs.Path(top)
        folder.getFileSystem(conf).delete(folder, True)
