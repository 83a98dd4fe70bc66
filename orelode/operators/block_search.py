"""Exact top-k over a stored index that reads only the blocks a query can need.

1. Every term's highest blocks, up to ``FIRST`` postings, give each query some chunks; the best of these are scored in
   full by their own terms, and the k-th best is a score that the result can't fall below.
2. A block's bound is its highest impact times the term's weight. As one is read, its term's bound for what is still
   unread falls to that of its next block. Blocks are taken in order of how far bounds fall for each posting read: rare
   terms whole, common ones their top or nothing. Once the bounds add up to less than the k-th score, a chunk that was in
   none of the blocks read can't reach it. Reading goes on to a part of it (``MARGIN``), since
   what is unread is also what a chunk that was met may lack; the rest is skipped.
3. The best chunks by now are scored in full, for a higher k-th score. Of those met, the ones whose parts so far and
   bounds of their other terms reach it are scored in full, and ranked.

What is decided by query is a few dozen rows a term, whatever the corpus. All scores that are
compared are rounded as they are given, with ``SLACK`` on the side of reading more. Chunks' terms are read by slot: a
few candidates touch a few slots.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.operators import text_index as X
from orelode.session import settled

#: More than the rounding of scores to six places can hide.
SLACK = 2e-6
#: Part of the k-th score that unread postings may add up to; chunks that are tried for it, as a multiple of k.
MARGIN, TRIED = 0.6, 2
#: Postings of a term that are read for the first chunks; a query reads one block at least.
FIRST = 512

Filter = Callable[[DataFrame], DataFrame]


class Asked(NamedTuple):
    """Queries over an index: all blocks of their terms, ``query_id, term, bucket, idf, block, nth, n, upto, gain,
    bound, next``; the buckets; whether they go to all tasks."""

    index: X.Index
    blocks: DataFrame
    buckets: list[int]
    small: bool

    def sent(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if self.small else rows

    @property
    def weights(self) -> DataFrame:
        return self.blocks.filter("nth = 1").select("query_id", "term", "idf")


def asked_of(index: X.Index, queries: DataFrame) -> Asked:
    asked = settled(X.query_terms(queries).select("query_id", "term", X.bucket(F.col("term"), index.buckets).alias("bucket")))
    n, buckets = asked.agg(F.count(F.lit(1)), F.collect_set("bucket")).first()  # as many as there are buckets at most
    small = n <= X.SENT
    terms = asked.select("term").distinct()
    own = index.blocks.filter(F.col("bucket").isin(buckets)).join(F.broadcast(terms) if small else terms, "term")
    within = Window.partitionBy("bucket", "term")  # a few dozen rows
    order = within.orderBy("block")
    own = own.withColumns({"idf": X.weight(F.sum("n").over(within), index.chunks), "next": F.coalesce(F.lead("impact").over(order), F.lit(0.0)), "nth": F.row_number().over(order), "upto": F.sum("n").over(order)})
    gain = F.col("idf") * (F.first("impact").over(order) - F.col("next")) / F.col("upto")
    own = own.withColumn("gain", gain).withColumn("gain", F.min("gain").over(order))  # so a term's blocks stay in order
    rows = asked.drop("bucket").join(own, "term")
    blocks = settled(rows.select("query_id", "term", "idf", "block", "nth", "n", "upto", "gain", (F.col("idf") * F.col("impact")).alias("bound"), (F.col("idf") * F.col("next")).alias("next")))
    return Asked(index, blocks, buckets, small)


def met(asked: Asked, chosen: DataFrame) -> DataFrame:
    """``query_id, chunk_id, part, rest`` of the postings before each query and term's ``depth`` (with ``idf``, ``rest``)."""
    index, deepest = asked.index, chosen.groupBy("term").agg(F.max("depth").alias("deepest"))
    some = index.postings.filter(F.col("bucket").isin(asked.buckets)).select("term", "block", "chunk_id", "tf", "length")
    some = some.join(asked.sent(deepest), "term").filter("block < deepest")
    rows = some.join(asked.sent(chosen.select("query_id", "term", "idf", "depth", "rest")), "term").filter("block < depth")
    return rows.select("query_id", "chunk_id", (F.col("idf") * X.impact(F.col("tf"), F.col("length"), index.average)).alias("part"), "rest")


def in_full(asked: Asked, pairs: DataFrame, few: bool = False) -> DataFrame:
    """``query_id, chunk_id, score, matched`` of pairs (query_id, chunk_id), by the chunks' own terms; ``few``: look first which slots they are in."""
    index = asked.index
    forward = index.forward.select("chunk_id", "length", "terms", "slot")
    if few:
        slots = [r[0] for r in pairs.select(X.bucket(F.col("chunk_id").cast("string"), index.slots)).distinct().collect()]  # a row for each slot at most
        forward = forward.filter(F.col("slot").isin(slots))
    rows = pairs.join(forward.drop("slot"), "chunk_id").select("query_id", "chunk_id", "length", F.inline("terms"))
    rows = rows.join(asked.sent(asked.weights), ["query_id", "term"])
    part = F.col("idf") * X.impact(F.col("tf"), F.col("length"), index.average)
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_list("term")).alias("matched"))


def tried(asked: Asked, found: DataFrame, by: str, limit: int) -> DataFrame:
    """``query_id, least``: the k-th score of each query's best chunks so far, in full."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "chunk_id"))
    some = settled(found.select("query_id", "chunk_id", by).withColumn("place", best).filter(F.col("place") <= TRIED * limit).select("query_id", "chunk_id"))
    return kth(in_full(asked, F.broadcast(some) if some.count() <= X.SENT else some, few=True), limit)


def kth(scored: DataFrame, limit: int) -> DataFrame:
    """``query_id, least``: the ``limit``-th best score; none for queries with fewer."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scored.select("query_id", place.alias("place"), F.col("score").alias("least")).filter(F.col("place") == limit).drop("place")


def planned(blocks: DataFrame, least: DataFrame) -> DataFrame:
    """The blocks with ``read``, and ``least``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term", "block")  # a few dozen rows a term
    before = F.coalesce(F.sum(F.col("bound") - F.col("next")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    highest = F.sum(F.when(F.col("nth") == 1, F.col("bound"))).over(Window.partitionBy("query_id"))
    rows = blocks.withColumn("unread", highest - before).join(least, "query_id", "left")
    return rows.withColumn("read", F.col("least").isNull() | (F.col("unread") >= MARGIN * F.col("least") - SLACK)).drop("unread")


def plan_of(asked: Asked, limit: int, lets: Filter) -> DataFrame:
    least = F.min(F.when(F.col("nth") == 1, F.struct("n", "term"))).over(Window.partitionBy("query_id"))
    rows = asked.blocks.filter("nth = 1 OR upto <= %d" % FIRST).withColumn("one", least["term"] == F.col("term"))
    rows = rows.filter((F.col("upto") <= FIRST) | (F.col("one") & (F.col("nth") == 1)))
    first = met(asked, rows.groupBy("query_id", "term", "idf").agg((F.max("block") + 1).alias("depth"), F.lit(0.0).alias("rest")))
    some = lets(first.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("part")))
    return settled(planned(asked.blocks, tried(asked, some, "part", limit)))


def search(index: X.Index, queries: DataFrame, limit: int, lets: Filter | None = None) -> DataFrame:
    """``query_id, chunk_id, score, matched, rank`` of the best ``limit`` chunks of each query, ties by chunk id.

    The same as scoring all chunks. ``lets`` takes pairs (query_id, chunk_id and others) and returns those admitted.
    Queries without a term of the index have no rows.
    """
    lets = lets or (lambda pairs: pairs)
    asked = asked_of(index, queries)
    plan = plan_of(asked, limit, lets)
    of = plan.groupBy("query_id", "term", "idf").agg(F.coalesce(F.max(F.when(F.col("read"), F.col("block") + 1)), F.lit(0)).alias("depth"), F.coalesce(F.max(F.when(~F.col("read"), F.col("bound"))), F.lit(0.0)).alias("rest"), F.first("least").alias("least"))
    whole = of.groupBy("query_id").agg(F.sum("rest").alias("unread"), F.first("least").alias("least"))
    found = met(asked, of.filter("depth > 0")).groupBy("query_id", "chunk_id").agg(F.sum(F.col("part") - F.col("rest")).alias("gain"))
    found = settled(lets(found.join(asked.sent(whole), "query_id").filter(F.col("least").isNull() | (F.col("gain") + F.col("unread") >= F.col("least") - SLACK))))
    higher = tried(asked, found, "gain", limit).withColumnRenamed("least", "higher")
    hopeful = found.join(asked.sent(higher), "query_id", "left").filter(F.col("higher").isNull() | (F.col("gain") + F.col("unread") >= F.col("higher") - SLACK))
    hopeful = settled(hopeful.select("query_id", "chunk_id"))
    return X.top(in_full(asked, F.broadcast(hopeful) if hopeful.count() <= X.SENT else hopeful), limit)  # else chunks' terms are shuffled


def report(index: X.Index, queries: DataFrame, limit: int) -> DataFrame:
    """Blocks and postings that a search of each query reads and skips."""
    plan = plan_of(asked_of(index, queries), limit, lambda pairs: pairs)
    read, skipped = F.col("read"), ~F.col("read")
    return plan.groupBy("query_id").agg(*[F.count_if(c).alias(f"blocks_{k}") for k, c in (("read", read), ("skipped", skipped))], *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"postings_{k}") for k, c in (("read", read), ("skipped", skipped))])
