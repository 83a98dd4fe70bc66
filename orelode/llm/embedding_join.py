"""Near-duplicate vectors by an exact metric range join.

Cosine at least ``threshold`` is a distance of at most r = sqrt(2 - 2 threshold) between unit vectors. Equal vectors are
one point with a weight. Pivots, drawn from the points, split them into cells by the nearest pivot; for a point x of
cell p and a point y of cell q within r, d(x, q) <= d(x, p) + 2 r by the triangle inequality, so x is replicated to
those higher cells q for which that holds, and each pair meets exactly once: in the higher cell. Large cells are cut
into blocks, which count as cells of their own. The last blocks may get a replica of nearly every point: a block is dealt
out to as many pieces as its replicas ask for, each with the block's own points and a share of the replicas, and each
joins these in tiles, by itself.

Within a block, points form balls around leaders of radius ``BALL`` at most, all of whose points link. Where the triangle
inequality settles a pair of a point and a ball, its points are counted at once, so that dense groups cost their number
of balls, not of pairs, and one link of a point to a ball stands for all. A piece returns a count for each point and a
forest of links, never all pairs.

Vectors of other lengths meet no others. Lengths of at most a block of points are joined all together, a length a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.components import Forest, components, grouped_back
from orelode.llm.runtime import column, record, task, written

#: Points in a block (a piece of it has twice as many replicas), points of a tile, and pivots at most (their table is broadcast).
BLOCK, TILE, PIVOTS = 8_192, 1_024, 4_096
#: Points up to which a length is one block, without pivots; more are cut into PARTS blocks at least.
WHOLE, PARTS = 256, 8
#: Radius of balls, and the slack that keeps rounding from settling a pair.
BALL, SLACK = 0.05, 1e-7
PLACED = pa.schema([("block", pa.int64()), ("home", pa.bool_()), ("point", pa.int64()), ("weight", pa.int64()), ("vector", pa.binary())])
FOUND = pa.schema([("point", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])
POINT = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def as_bytes(batches):
    """Vectors as packed doubles; null for those that link with nothing."""
    for batch in batches:
        out = []
        for v in column(batch, "embedding"):
            ok = v is not None and len(v) and None not in v
            a = np.array(v, np.float64) if ok else None
            ok = ok and np.isfinite(a).all() and a.any()
            if ok and not np.isfinite((a * a).sum()) or ok and (a * a).sum() < 1e-290:
                a = a / np.abs(a).max()
            out.append((a + 0.0).tobytes() if ok else None)
        yield record(POINT, vec_id=batch.column("vec_id"), vector=out)


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column(batch, "vector")), np.float64).reshape(batch.num_rows, -1))


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to all pivots, and the nearest pivot of each point (the first of equals)."""
    d = np.sqrt(np.maximum(0, 2 - 2 * points @ pivots.T))
    return d, d.argmin(axis=1)


def near_cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each point's home cell, and whether it may have partners in each of the cells from there on."""
    d, home = nearest(x, pivots)
    near = d <= d[np.arange(len(x)), home][:, None] + 2 * reach + SLACK
    return home, near & (np.arange(len(pivots)) >= home[:, None])


def home_cells(batches, pivots, reach: float):
    """The number of points of each cell, and of those of others that may have partners in it."""
    counts = None
    for batch in batches:
        if batch.num_rows:
            home, near = near_cells(rows_of(batch), pivots.value, reach)
            own = np.bincount(home, minlength=len(pivots.value))
            made = np.stack([own, near.sum(axis=0) - own])
            counts = made if counts is None else counts + made
    if counts is not None:
        yield pa.RecordBatch.from_pydict({"cell": np.arange(counts.shape[1]), "n": counts[0].astype(np.int64), "guests": counts[1].astype(np.int64)})


def layout(counts: np.ndarray, guests: np.ndarray, block: int, piece: int) -> tuple[np.ndarray, ...]:
    """By cell the first block and their number; by block the first piece and their number."""
    of = np.maximum(1, -(-counts // block))
    first = np.cumsum(of) - of
    cell = np.repeat(np.arange(len(of)), of)
    nth = np.arange(len(cell)) - first[cell]  # a cell's earlier blocks are guests of its later ones
    replicas = guests[cell] + nth * -(-counts[cell] // of[cell])
    pieces = np.maximum(1, -(-replicas // piece))
    return first, of, np.cumsum(pieces) - pieces, pieces


def expanded(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ranges: which range each is in, and its member."""
    which = np.repeat(np.arange(len(of)), of)
    return which, first[which] + np.arange(len(which)) - (np.cumsum(of) - of)[which]


def placed(batches, pivots, blocks, reach: float):
    """Each point in all pieces of its block, and replicas in a piece of each higher one that it may have partners in."""
    p, (first, of, first_piece, pieces) = pivots.value, blocks.value
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            some = batch.slice(at, 1_000)
            x, point = rows_of(some), some.column("point").to_numpy(zero_copy_only=False)
            home, near = near_cells(x, p, reach)
            block = first[home] + point % of[home]
            who, cell = np.nonzero(near)
            which, to = expanded(first[cell], of[cell])
            who = who[which]
            who, to = who[to > block[who]], to[to > block[who]]
            guests = first_piece[to] + point[who] % pieces[to]
            own, at_home = expanded(first_piece[block], pieces[block])
            rows = np.concatenate([own, who])
            for k in range(0, len(rows), 20_000):
                part = rows[k : k + 20_000]
                taken = some.select(["point", "weight", "vector"]).take(pa.array(part))
                yield record(PLACED, block=np.concatenate([at_home, guests])[k : k + 20_000], home=np.arange(k, k + len(part)) < len(own), point=taken.column("point"), weight=taken.column("weight"), vector=taken.column("vector"))


class Balls:
    """Points of a block by leaders: each point lies within ``ball`` of its own."""

    def __init__(self, x: np.ndarray, ball: float):
        self.of, leaders = np.full(len(x), -1), []
        for at in range(0, len(x), 256):
            close = x[at : at + 256] @ x.T >= 1 - ball * ball / 2
            for i in range(at, min(at + 256, len(x))):
                if self.of[i] < 0:
                    self.of[(self.of < 0) & close[i - at]] = len(leaders)
                    self.of[i] = len(leaders)
                    leaders.append(i)
        self.leaders = np.array(leaders)
        self.order = np.argsort(self.of, kind="stable")
        self.cuts = np.searchsorted(self.of[self.order], np.arange(len(leaders) + 1))
        self.radius = np.array([np.sqrt(((x[self.own(k)] - x[j]) ** 2).sum(axis=1)).max() for k, j in enumerate(leaders)])

    def own(self, k: int) -> np.ndarray:
        return self.order[self.cuts[k] : self.cuts[k + 1]]


class Block:
    """Counts and links of one block's points."""

    def __init__(self, x: np.ndarray, points: np.ndarray, weights: np.ndarray, threshold: float):
        self.x, self.points, self.weights, self.threshold = x, points, weights, threshold
        self.reach, self.n, self.forest = float(np.sqrt(2 - 2 * threshold)), np.zeros(len(x), np.int64), Forest()
        self.balls = Balls(x, min(BALL, self.reach / 2))
        for k, j in enumerate(self.balls.leaders):
            for p in points[self.balls.own(k)].tolist():
                self.forest.link(p, int(points[j]))
        self.ball_weight = np.bincount(self.balls.of, weights, minlength=len(self.balls.leaders)).astype(np.int64)
        most, least = self.reach + SLACK + self.balls.radius, self.reach - SLACK - self.balls.radius
        self.some, self.all = 1 - most * most / 2, np.where(least > 0, 1 - least * least / 2, 2)  # a leader's cosine from which some of its ball, and all of it, are within reach

    def meet(self, y: np.ndarray, points: np.ndarray, weights: np.ndarray, own: bool) -> np.ndarray:
        """Adds links with others; returns the others' counts. ``own``: the others are the block's points themselves."""
        n, b = np.zeros(len(y), np.int64), self.balls
        cosine = y @ self.x[b.leaders].T
        maybe = cosine >= self.some
        if not maybe.any():
            return n
        inside = cosine >= self.all
        maybe &= ~inside
        n += inside @ self.ball_weight
        for k in np.flatnonzero(inside.any(axis=0)):
            rows = np.flatnonzero(inside[:, k])
            mine = b.own(k)
            if not own:
                self.n[mine] += weights[rows].sum()
            self.link(points[rows], k)
        for k in np.flatnonzero(maybe.any(axis=0)):
            rows, mine = np.flatnonzero(maybe[:, k]), b.own(k)
            hit = y[rows] @ self.x[mine].T >= self.threshold
            n[rows] += hit @ self.weights[mine]
            if not own:
                self.n[mine] += weights[rows] @ hit
            self.link(points[rows[hit.any(axis=1)]], k)
        return n

    def link(self, points: np.ndarray, ball: int) -> None:
        """Links points with a ball, by its leader: the ball's own points are linked already."""
        top = int(self.points[self.balls.leaders[ball]])
        for p in points.tolist():
            self.forest.link(p, top)

    def own_links(self):
        """Links within the block; a point's own weight isn't among its count."""
        for at in range(0, len(self.x), TILE):
            part = slice(at, at + TILE)
            self.n[part] += self.meet(self.x[part], self.points[part], self.weights[part], True) - self.weights[part]


def join_block(batches, threshold: float, blocks=None):
    """Rows come sorted by piece, the block's own points first. Counts (other is null) and links (n is 0).

    A block's own points meet each other in its first piece.
    """
    block, held, made = None, [], None
    firsts = None if blocks is None else set(blocks.value[2].tolist())

    def own() -> Block:
        x, points, weights = (np.concatenate(c) for c in zip(*held, strict=True))
        out = Block(x, points, weights, threshold)
        if firsts is None or block in firsts:
            out.own_links()
        return out

    def done(b: Block):
        hit = np.flatnonzero(b.n)
        stars = list(b.forest.stars())
        yield record(FOUND, point=[*b.points[hit].tolist(), *(p for p, _ in stars)], other=[*[None] * len(hit), *(q for _, q in stars)], n=[*b.n[hit].tolist(), *[0] * len(stars)])

    for batch in batches:
        blocks, home = batch.column("block").to_numpy(zero_copy_only=False), batch.column("home").to_numpy(zero_copy_only=False)
        key = blocks * 2 + ~home
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if blocks[a] != block:
                if held:
                    yield from done(made or own())
                block, held, made = blocks[a], [], None
            some = batch.slice(a, b - a)
            rows = rows_of(some), some.column("point").to_numpy(zero_copy_only=False), some.column("weight").to_numpy(zero_copy_only=False)
            if home[a]:
                held.append(rows)
            elif held:
                made = made or own()
                for at in range(0, len(rows[0]), TILE):
                    y, points, weights = (r[at : at + TILE] for r in rows)
                    n = made.meet(y, points, weights, False)
                    hit = np.flatnonzero(n)
                    if len(hit):
                        yield record(FOUND, point=points[hit], other=[None] * len(hit), n=n[hit])
    if held:
        yield from done(made or own())


def linked(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Vectors that are null, empty, zero or have null or non-finite components link with nothing; vectors of different
    lengths don't link with each other. Equal vectors link. Repeated rows are vectors each; a null key is no least of a
    component that has another; other columns go; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    packed = written(rows.mapInArrow(task(__name__, "as_bytes"), "vec_id long, vector binary"))
    good = packed.filter("vector IS NOT NULL")
    points = written(good.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight")).withColumn("point", F.monotonically_increasing_id()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = points.groupBy(F.octet_length("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    whole = min(block, WHOLE)
    few = points.join(sizes.filter(F.col("n") <= whole), F.octet_length("vector") == F.col("size"), "left_semi")
    home = few.select(F.octet_length("vector").cast("long").alias("block"), F.lit(True).alias("home"), "point", "weight", "vector")
    found = home.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(task(__name__, "join_block", threshold=threshold), "point long, other long, n long")
    for size, total in sorted(sizes.filter(F.col("n") > whole).collect()):  # lengths of hundreds of points each
        own = min(block, max(whole, -(-total // PARTS)))
        same = points.filter(F.octet_length("vector") == size)
        reach = float(np.sqrt(2 - 2 * threshold))
        draw = sorted(same.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(min(PIVOTS, max(1, round((total / own) ** 0.5 * 4)))).collect())
        pivots = spark.sparkContext.broadcast(unit(np.frombuffer(b"".join(bytes(r[0]) for r in draw), np.float64).reshape(len(draw), -1)))
        counts = np.zeros((2, len(draw)), np.int64)
        for r in same.select("vector").mapInArrow(task(__name__, "home_cells", pivots=pivots, reach=reach), "cell long, n long, guests long").groupBy("cell").sum("n", "guests").collect():
            counts[:, r[0]] = r[1], r[2]
        blocks = spark.sparkContext.broadcast(layout(*counts, own, 2 * own))
        dealt = same.select("point", "weight", "vector").mapInArrow(task(__name__, "placed", pivots=pivots, blocks=blocks, reach=reach), "block long, home boolean, point long, weight long, vector binary")
        n = max(tasks, min(3 * int(blocks.value[3].sum()), 20 * tasks))  # given, as a piece's work grows faster than its bytes
        joined = dealt.repartition(n, "block").sortWithinPartitions("block", F.desc("home")).mapInArrow(task(__name__, "join_block", threshold=threshold, blocks=blocks), "point long, other long, n long")
        found = found.unionByName(joined)
    found = written(found)
    n = found.filter("other IS NULL").groupBy("point").agg(F.sum("n").alias("others"))
    classes = written(components(found.filter("other IS NOT NULL"), "point", "other").withColumnRenamed("node", "point").join(points.select("point", "low"), "point"))
    lows = grouped_back(classes, "component", F.min("low"), "least_id", classes.count()).select("point", "least_id")
    whole = written(points.join(n, "point", "left").join(lows, "point", "left").select("vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least_id", "low").alias("component_id")))
    out = good.join(whole, "vector").select("vec_id", "n_links", "component_id")
    rest = packed.filter("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
    SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
    SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
), counted AS (
    SELECT a AS r, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least USING (r) LEFT JOIN counted USING (r)
"""
