"""Connected components of a table of edges, by alternating stars over written tables.

Each round first contracts what a task holds by itself (a union-find over its rows, each component as a star around its
least node), then links every node to the least of its larger neighbourhood, and then to the least of its smaller one.
Rounds end when nothing changes; they grow with the logarithm of the longest path. The least neighbour of a node comes
from a partial aggregate. Where it is joined back, nodes with more than a thousandth of all edges (so at most 2,000)
are joined by broadcast, all others by shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import dropped, task, written

CHUNK = 500_000


class Forest:
    """Union-find whose roots are least nodes."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up, r = self.up, x
        while (y := up.get(r, r)) != r:
            r = y
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = (a, b) if a > b else (b, a)
            self.up[a] = b

    def stars(self):
        return ((x, self.root(x)) for x in list(self.up) if self.root(x) != x)


def contract(batches):
    """Stars of the components that a task's edges form, in chunks of bounded size."""
    forest, kind = Forest(), None

    def out():
        rows = list(forest.stars())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], kind), pa.array([b for _, b in rows], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.link(a, b)
        if len(forest.up) > CHUNK:
            yield from out()
            forest = Forest()
    if forest.up:
        yield from out()


def grouped_back(rows: DataFrame, key: str, value, name: str, total: int) -> DataFrame:
    """``rows`` with an aggregate of their group by ``key`` (not null) as column ``name``, without a window.

    Groups with more than a thousandth of ``total`` rows, so at most 1,000, are joined by broadcast.
    """
    sums = rows.groupBy(key).agg(value.alias(name), F.count(F.lit(1)).alias("group_rows"))
    hot = sums.filter(F.col("group_rows") > max(100, total // 1000)).select(key, F.struct(name).alias("hot_group"))
    both = rows.join(F.broadcast(hot), key, "left")
    rest = both.filter(F.col("hot_group").isNull()).drop("hot_group").join(sums.drop("group_rows"), key)
    found = both.filter(F.col("hot_group").isNotNull()).withColumn(name, F.col(f"hot_group.{name}")).drop("hot_group")
    return found.unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node with an edge to another; ``component`` is the least node reachable.

    Nodes are of any type with an order. Edges to nulls and to the node itself link nothing; repeated edges count once;
    an empty table gives an empty one.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    kind = edges.schema["a"].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    stars = written(edges.mapInArrow(task(__name__, "contract"), schema).distinct())
    seen = None
    while True:
        now = tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now[0] == 0 or now == seen or stars.groupBy("a").count().filter("count > 1").isEmpty() and stars.join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return stars.unionByName(stars.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = written(grouped_back(both, "u", F.least(F.min("v"), F.first("u")), "m", 2 * now[0]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        linked = grouped_back(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "u", F.min("v"), "m", now[0])
        small = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(linked.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        after = written(small.mapInArrow(task(__name__, "contract"), schema).distinct())
        dropped(large)
        dropped(stars)
        stars = after
