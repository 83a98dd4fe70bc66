"""Graph retrieval: seeds, bounded breadth-first walks, rationed collection.

Walks of a whole batch of queries run together, one pair of joins for each hop. Of several parents in one hop the one
that is earliest in the queue counts, then the edge's type, the neighbour and the edge's key; the first discovery fixes
a node's hop and path. Walks run on numbers; names and paths are joined in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V
from orelode.operators.numbering import numbered
from orelode.session import settled

#: Rows of a level up to which its paths are sent to all tasks.
SENT = 50_000


def identifier_index(nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``key, node_id`` for each distinct identifier (trimmed, lower-cased) of a node."""
    keys = F.filter(F.array_distinct(F.transform(F.array(*[F.col(c).cast("string") for c in columns]), lambda v: F.lower(stripped(v)))), lambda k: k.isNotNull() & (k != ""))
    return nodes.select("node_id", F.explode(keys).alias("key"))


def redirects(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(V.REDIRECTS.items()), "original string, successor string"))  # 13 rows


def seeds(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``asked`` (query_id, ordinal, value) with ``status, node_ids, successor``: resolved, ambiguous, redirected or unresolved.

    A value without a node is followed to its successor if that one has exactly one node.
    """
    def nodes_of(rows: DataFrame, name: str) -> DataFrame:
        """Each distinct key's nodes are gathered once, then joined with what asks for it."""
        keys = rows.select("key").distinct()
        per = index.join(keys, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("node_id")).alias(name))
        return rows.join(per, "key", "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{dict(index.dtypes)['node_id']}>"))).drop("key")

    found = nodes_of(asked.select("query_id", "ordinal", "value", F.lower(stripped("value")).alias("key")), "node_ids")
    moved = found.filter(F.size("node_ids") == 0).withColumn("original", F.upper(stripped("value"))).join(redirects(asked.sparkSession), "original")
    moved = nodes_of(moved.select("query_id", "ordinal", "successor", F.lower("successor").alias("key")), "new_ids")
    rows = found.join(moved.select("query_id", "ordinal", "successor", "new_ids"), ["query_id", "ordinal"], "left")
    follow = (F.size("node_ids") == 0) & (F.coalesce(F.size("new_ids"), F.lit(0)) == 1)
    status = F.when(F.size("node_ids") == 1, "resolved").when(F.size("node_ids") > 1, "ambiguous").when(follow, "redirected").otherwise("unresolved")
    return rows.select("query_id", "ordinal", "value", status.alias("status"), F.when(follow, F.col("new_ids")).otherwise(F.col("node_ids")).alias("node_ids"), F.when(follow, F.col("successor")).alias("successor"))


def start_nodes(reports: DataFrame) -> DataFrame:
    """The nodes that walks start from: of several values of a query, the first that names a node."""
    rows = reports.filter(F.col("status").isin("resolved", "redirected")).select("query_id", "ordinal", "value", F.get("node_ids", F.lit(0)).alias("node_id"))
    return rows.groupBy("query_id", "node_id").agg(F.min_by("value", "ordinal").alias("value"), F.min("ordinal").alias("ordinal"))


def queued(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3 ... in each query's queue."""
    return numbered(rows, ["query_id"], order, "rank").withColumn("rank", F.col("rank") + 1)


class Walk(NamedTuple):
    """What a walk reached, by numbers.

    ``levels``: for each hop ``query_id, node, hop, rank, from, way``, with the rank of the parent and the way taken (null
    for starts); ``nodes``: ``node, node_id``; ``ways``: ``way, node_id, key``, with the node that it leads to.
    """

    levels: list[DataFrame]
    nodes: DataFrame
    ways: DataFrame

    @property
    def reached(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [level.select("query_id", "node", "hop", "rank") for level in self.levels])


def walk(starts: DataFrame, edges: DataFrame, hops: int = 2) -> Walk:
    """The nodes within ``hops`` of a query's starts (query_id, node_id, ordinal), without names and paths.

    ``edges`` (key, type, start_id, end_id) count both ways; one that lacks an end links nothing. Each way of an edge has a
    number by type, node it leads to and key, so that it stands for all three in a queue's order, and each node has one by its
    id. What is shuffled and written for each node that is reached are a few numbers. Queues are numbered by ranges, so one
    query's level runs in as many tasks as its rows fill.
    """
    one, other = (F.struct(F.col(x).alias("node_id"), F.col(y).alias("next"), "type", "key") for x, y in (("start_id", "end_id"), ("end_id", "start_id")))
    both = edges.filter("start_id IS NOT NULL AND end_id IS NOT NULL").select(F.inline(F.array(one, other)))
    both = settled(numbered(settled(both), [], ["type", "next", "key"], "way"))
    starts = settled(starts.select("query_id", "node_id", "ordinal"))
    nodes = settled(numbered(settled(both.select("node_id").union(starts.select("node_id")).distinct()), [], ["node_id"], "node"))
    near = both.select("way", "node_id", "next").join(nodes, "node_id").select("way", F.col("node").alias("at"), F.col("next").alias("node_id"))
    near = settled(near.join(nodes, "node_id").select("at", "way", "node"))
    level = queued(settled(starts.join(nodes, "node_id").drop("node_id").withColumn("node_id", F.col("node"))), ["ordinal", "node_id"])
    none = F.lit(None).cast("long")
    levels = [settled(level.select("query_id", "node", F.lit(0).alias("hop"), "rank", none.alias("from"), none.alias("way")))]
    for hop in range(1, hops + 1):
        reach = levels[-1].select("query_id", F.col("node").alias("at"), "rank").join(near, "at").select("query_id", "node", F.lit(hop).alias("hop"), "rank", "way")
        seen = [level.select("query_id", "node", "hop", "rank", F.lit(0).cast("long").alias("way")) for level in levels]
        first = reduce(DataFrame.unionByName, seen, reach).groupBy("query_id", "node").agg(F.min(F.struct("hop", "rank", "way")).alias("f"))
        first = settled(first.filter(F.col("f.hop") == hop).select("query_id", "node", F.col("f.rank").alias("from"), "f.way"))
        levels.append(settled(queued(first, ["from", "way"]).select("query_id", "node", F.lit(hop).alias("hop"), "rank", "from", "way")))
    return Walk(levels, nodes, both.select("way", F.col("next").alias("node_id"), "key"))


def walked(starts: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``query_id, node_id, hop, rank, path`` of ``walk``. ``rank`` is the place in the queue of its hop; ``path`` holds the
    keys of the edges. Names are joined in the end, and a level's paths are written only where the next one goes on from them.
    """
    of = walk(starts, edges, hops)
    named = [of.levels[0].join(of.nodes, "node").select("query_id", "node_id", "hop", "rank", F.array().cast("array<string>").alias("path"))]
    for hop, level in enumerate(of.levels[1:], 1):
        before = named[-1] if hop == 1 else settled(named[-1])
        parents = before.select("query_id", F.col("rank").alias("from"), F.col("path").alias("before"))
        if of.levels[hop - 1].count() <= SENT:
            parents = F.broadcast(parents)
        rows = level.join(of.ways, "way").join(parents, ["query_id", "from"])
        named.append(rows.select("query_id", "node_id", "hop", "rank", F.concat("before", F.array("key")).alias("path")))
    return reduce(DataFrame.unionByName, named)


def expanded(reached: DataFrame, candidates_of: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """Candidates of reached nodes (query_id, hop, rank), of as many nodes of each level as can matter to ``rationed``.

    ``candidates_of`` makes candidates (query_id, hop, place ...; places in the order of ranks) of some of the nodes. A
    level is expanded from its first ranks on, in slices that double, until it has ``limit`` candidates or no more nodes:
    no ration goes beyond a level's first ``limit``. So a hub's neighbours are joined as far as they are needed.
    """
    still = settled(reached.groupBy("query_id", "hop").agg(F.max("rank").alias("last"), F.lit(0).cast("long").alias("have")))
    out, low, high = None, 0, limit
    while True:
        some = reached.filter((F.col("rank") > low) & (F.col("rank") <= high)).join(still.select("query_id", "hop"), ["query_id", "hop"])
        rows = settled(candidates_of(some))
        out = rows if out is None else out.unionByName(rows)
        more = still.join(rows.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n")), ["query_id", "hop"], "left")
        still = settled(more.select("query_id", "hop", "last", (F.col("have") + F.coalesce("n", F.lit(0))).alias("have")).filter((F.col("have") < limit) & (F.col("last") > high)))
        if still.isEmpty():
            return out
        low, high = high, 2 * high


def rationed(candidates: DataFrame, levels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` candidates (query_id, hop, place) of each query: seeds first, then equal shares of what is left
    for each deeper level that was reached (``levels``: query_id, hop), and what levels leave over in the order of hops.
    """
    n = levels.join(candidates.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("n")), ["query_id", "hop"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = Window.partitionBy("query_id")
    n = n.withColumn("seeds", F.least(F.max(F.when(F.col("hop") == 0, F.col("n")).otherwise(0)).over(of), F.lit(limit)))
    n = n.withColumn("deeper", F.count_if(F.col("hop") > 0).over(of))
    n = n.withColumn("share", F.when(F.col("hop") == 0, F.col("seeds")).otherwise(F.least("n", F.floor((F.lit(limit) - F.col("seeds")) / F.greatest("deeper", F.lit(1))))))
    n = n.withColumn("left", F.lit(limit) - F.sum("share").over(of)).withColumn("want", F.col("n") - F.col("share"))
    before = F.coalesce(F.sum("want").over(of.orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("quota", F.col("share") + F.greatest(F.lit(0), F.least("want", F.col("left") - before)))
    nth = F.row_number().over(Window.partitionBy("query_id", "hop").orderBy("place"))
    return candidates.withColumn("nth", nth).join(n.select("query_id", "hop", "quota"), ["query_id", "hop"]).filter("nth <= quota").drop("quota")
