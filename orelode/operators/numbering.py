"""Row numbers of any order without a window over the rows: no group goes through one task, however large it is.

Rows are dealt by ranges of the order, so each partition holds a stretch of it. A row's number is its place in the
stretch plus the rows of its group in the stretches before. Only counts of stretches are added up: as many rows as
there are partitions and groups together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.session import settled

#: Bits of ``monotonically_increasing_id`` that count a partition's rows.
ROW_BITS = 33


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case, near the wanted ones."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``, a long: 0, 1, 2 ... within each group of ``by`` (none: of all rows) in this order.

    Rows that the order doesn't tell apart are numbered in any order, and go to different partitions all the same, so
    many copies of a row are no hot spot. Null keys are a group of their own; nulls sort as ``order`` says, first if it
    names columns. The input is read twice (for the ranges' bounds), so settle one that is dear. An empty table gives an
    empty one.
    """
    tie, place, part, first, n, before = unused(df, "tie", "place", "part", "first", "n", "before")
    keys = [*by, *order, tie]
    rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = settled(rows.drop(tie).withColumn(place, F.monotonically_increasing_id())).withColumn(part, F.shiftright(place, ROW_BITS))
    counts = rows.groupBy(part, *by).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(first))
    theirs = unused(rows, *[f"{c}_counted" for c in (part, *by)])
    counts = counts.select(before, *[F.col(c).alias(t) for c, t in zip((part, *by), theirs, strict=True)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(t)) for c, t in zip((part, *by), theirs, strict=True)])
    return rows.join(counts, same).select(*df.columns, (F.col(place) + F.col(before)).alias(name))
