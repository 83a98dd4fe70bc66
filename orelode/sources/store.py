"""A keyed table that merges by copy on write.

Rows lie in buckets by a hash of their key. A merge compares what comes with what is there, rewrites only the buckets
with a changed row, into a folder of its own, and then writes a manifest that names each bucket's folder. Readers take
the last manifest that was finished, so they see one version as a whole, and a merge that failed is never seen. The
same rows again change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from orelode.session import settled

BUCKETS = 64
MANIFEST = "bucket int, folder string, n long"


def _folders(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store, ([s.getPath() for s in store.listStatus(folder)] if store.exists(folder) else [])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, in order."""
    store, found = _folders(spark, f"{path}/versions")
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``bucket, folder, n`` of a version (the last one); a row for each bucket at most."""
    have = versions(spark, path)
    if not have or version is not None and version not in have:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/versions/{have[-1] if version is None else version}")


def _rows(spark: SparkSession, path: str, schema, entries) -> DataFrame:
    files = [f"{path}/{e.folder}/bucket={e.bucket}" for e in entries]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version (the last one)."""
    return _rows(spark, path, schema, manifest(spark, path, version).collect())


def _content(df: DataFrame, columns: list[str]) -> Column:
    """A row's content as text; maps by the order of their keys."""
    kept = [F.array_sort(F.map_entries(c)).alias(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in columns]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def merge(df: DataFrame, path: str, key: str, order: list[Column | str] | None = None, buckets: int = BUCKETS) -> dict[str, int]:
    """Rows of ``df`` take the place of those of their key, new keys are added, all others stay.

    Of several rows of a key the last by ``order`` counts (then by content, so a repeated merge does the same). Says how
    many rows came, were added, changed and written anew, and the version. A merge that changes nothing makes no version.
    A version that another merge has made meanwhile is an error, and the table stays as that one left it. The number of
    buckets is that of the first merge. Null keys are an error.
    """
    spark, columns = df.sparkSession, df.columns
    schema = df.schema
    last = versions(spark, path)
    entries = {e.bucket: e for e in manifest(spark, path).collect()}  # a row for each bucket
    if last:
        buckets = spark.read.parquet(f"{path}/buckets").first().buckets
    else:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    safe = F.when(F.col(key).isNull(), F.raise_error(F.lit("a row without a key can't be merged")).cast("string")).otherwise(F.col(key).cast("string"))
    rows = df.withColumn("merge_content", _content(df, columns)).withColumn("bucket", F.pmod(F.xxhash64(safe), F.lit(buckets)).cast("int"))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order or []], F.desc("merge_content")))
    came = settled(rows.withColumn("merge_nth", latest).filter("merge_nth = 1").drop("merge_nth"))
    met = sorted(r.bucket for r in came.select("bucket").distinct().collect())
    old = _rows(spark, path, schema, [entries[b] for b in met if b in entries])
    there = old.select(F.col(key).alias("merge_key"), _content(old, columns).alias("merge_was"))
    compared = came.join(there, F.col(key) == F.col("merge_key"), "left")
    changed = settled(compared.filter("merge_was IS NULL OR merge_was <> merge_content").select(*columns, "bucket", F.col("merge_was").isNull().alias("merge_new")))
    told = {r.bucket: r for r in changed.groupBy("bucket").agg(F.count_if("merge_new").alias("added"), F.count_if(~F.col("merge_new")).alias("changed")).collect()}
    out = {"came": came.count(), "added": sum(r.added for r in told.values()), "changed": sum(r.changed for r in told.values()), "written": 0, "version": last[-1] if last else 0}
    if not told:
        return out
    touched = _rows(spark, path, schema, [entries[b] for b in told if b in entries])
    stay = touched.join(changed.select(F.col(key).alias("merge_key")), F.col(key) == F.col("merge_key"), "left_anti")
    stay = stay.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    folder = f"data/{uuid.uuid4().hex}"
    stay.select(*columns, "bucket").unionByName(changed.select(*columns, "bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    sizes = {r.bucket: r["count"] for r in spark.read.parquet(f"{path}/{folder}").groupBy("bucket").count().collect()}
    new = {b: (b, folder, sizes[b]) for b in told}
    whole = [new.get(b) or tuple(entries[b]) for b in sorted(new.keys() | entries.keys())]
    out |= {"written": sum(sizes.values()), "version": out["version"] + 1}
    spark.createDataFrame(whole, MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/versions/{out['version']}")
    return out


def vacuumed(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the folders that none of the last ``keep`` versions names; says how many went."""
    have = versions(spark, path)
    named = {e.folder.rsplit("/", 1)[-1] for v in have[-keep:] for e in manifest(spark, path, v).collect()}
    store, found = _folders(spark, f"{path}/data")
    gone = [p for p in found if p.getName() not in named]
    for p in gone:
        store.delete(p, True)
    _, old = _folders(spark, f"{path}/versions")
    for p in old:
        if p.getName().isdigit() and int(p.getName()) in have[:-keep]:
            store.delete(p, True)
    return len(gone)
