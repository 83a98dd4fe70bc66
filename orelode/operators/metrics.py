"""Retrieval metrics over rankings (case, position, record) and judgments (case, record, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.session import settled


def collapsed(ranking: DataFrame) -> DataFrame:
    """The first place of each record of a case, and places counted anew."""
    first = ranking.groupBy("case_id", "record_id").agg(F.min("position").alias("position"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy("position", "record_id")))


def judged(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    return collapsed(ranking).join(judgments.select("case_id", "record_id", "grade"), ["case_id", "record_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def measures(ranking: DataFrame, judgments: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Precision, recall and nDCG at each k, and the reciprocal rank, for each case with a relevant record."""
    rows = judged(ranking, judgments)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("position") + 1.0)
    ideal_rows = judgments.withColumn("position", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "record_id")))
    hit = F.col("grade") > 0
    own = [F.coalesce(F.sum(F.when((F.col("position") <= k) & hit, 1)), F.lit(0)).alias(f"hits_{k}") for k in ks]
    own += [F.coalesce(F.sum(F.when(F.col("position") <= k, gain)), F.lit(0.0)).alias(f"dcg_{k}") for k in ks]
    own.append(F.min(F.when(hit, F.col("position"))).alias("first_hit"))
    ideal = [F.sum(F.when(F.col("position") <= k, gain)).alias(f"idcg_{k}") for k in ks]
    found = rows.groupBy("case_id").agg(*own)
    best = ideal_rows.filter(hit).groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), *ideal)
    out = best.join(found, "case_id", "left")
    zero = F.lit(0.0)
    cols = []
    for k in ks:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        cols += [F.round(hits / F.lit(float(k)), 6).alias(f"p_{k}"), F.round(hits / F.col("relevant"), 6).alias(f"r_{k}"), F.round(F.coalesce(F.col(f"dcg_{k}") / F.col(f"idcg_{k}"), zero), 6).alias(f"ndcg_{k}")]
    return out.select("case_id", *cols, F.round(F.coalesce(1.0 / F.col("first_hit"), zero), 6).alias("mrr"))


def means(values: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """Arithmetic means, over all cases or by a column."""
    aggs = [F.round(F.avg(n), 6).alias(n) for n in names]
    return (values.groupBy(by) if by else values.groupBy()).agg(F.count(F.lit(1)).alias("cases"), *aggs)


#: Parts of a range that are counted in a round, values that are sorted in the end, and ranks up to which they are sent to all tasks.
PARTS, LAST, SENT = 256, 10_000, 50_000


def selected(values: DataFrame, wanted: DataFrame, by: str, value: str) -> DataFrame:
    """``by, k, chosen``: the k-th smallest value (from 0) of each group, exactly, without sorting a group.

    ``wanted``: ``by, k, lo, hi, n`` with the least and greatest value and the number of values of the group. A round
    counts the values of a range by ``PARTS`` parts of equal width and goes on with the part that holds the rank, from
    its least to its greatest value; a part of ``LAST`` values at most is sorted. Every round parts the least from the
    greatest value, so ranges always shrink. Nulls and NaN are no values. Values are read once a round, so settle what
    is dear.
    """
    rows = values.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    targets = settled(wanted.select(F.col(by).alias("of"), "k", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    few = targets.count() <= SENT  # else groups are many, and rows go to their group's ranks by a shuffle
    done = None

    def inside(some: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(some) if few else some, F.col("g").eqNullSafe(F.col("of")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))

    while True:
        ready = targets.filter("lo = hi OR inside <= %d" % LAST)
        done = ready if done is None else done.unionByName(ready)
        still = targets.filter("lo < hi AND inside > %d" % LAST)
        if still.isEmpty():
            break
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1))
        counts = inside(still).groupBy("of", "k", "below", part.alias("part")).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy("of", "k").orderBy("part"))  # as many rows as there are parts
        placed = counts.withColumn("upto", F.col("below") + upto).filter((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("inside")))
        targets = settled(placed.select("of", "k", "lo", "hi", (F.col("upto") - F.col("inside")).alias("below"), "inside"))
    done = settled(done)
    one = done.filter("lo = hi").select(F.col("of").alias(by), "k", F.col("lo").alias("chosen"))
    nth = F.row_number().over(Window.partitionBy("of", "k").orderBy("v"))  # of LAST rows at most
    rest = inside(done.filter("lo < hi")).withColumn("nth", nth).filter(F.col("nth") == F.col("k") - F.col("below") + 1)
    return one.unionByName(rest.select(F.col("of").alias(by), "k", F.col("v").alias("chosen")))


def latency(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and p95 (the sorted value at int(0.95 n)), three places, of each group's values; null groups are one.

    Ranks are selected by counts, so no group is sorted or goes through one task. A group without a value has no row.
    """
    rows = values.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    whole = settled(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean")))
    ranks = {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2), "last": F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95).cast("double")))}
    asked = whole.withColumns(ranks)
    wanted = asked.select(by, "lo", "hi", "n", F.explode(F.array_distinct(F.array(*ranks))).alias("k"))
    found = selected(rows, wanted, by, value).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("k", "chosen"))).alias("at"))  # three ranks
    out = asked.join(found.withColumnRenamed(by, "of"), F.col(by).eqNullSafe(F.col("of")))
    at = lambda name: F.element_at("at", F.col(name))
    return out.select(by, F.round("mean", 3).alias("mean"), F.round((at("low") + at("high")) / 2, 3).alias("median"), F.round(at("last"), 3).alias("p95"))
