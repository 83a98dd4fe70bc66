import random

from pyspark.sql import functions as F

from orelode.operators import traverse as T


def plain_walk(starts, edges, hops):
    """One queue a query, level by level."""
    near = {}
    for key, kind, a, b in edges:
        near.setdefault(a, []).append((kind, b, key))
        near.setdefault(b, []).append((kind, a, key))
    out = set()
    for q in {s[0] for s in starts}:
        level = [(n, ()) for _, n in sorted((o, n) for p, n, o in starts if p == q)]
        seen = {n for n, _ in level}
        out |= {(q, n, 0, r, ()) for r, (n, _) in enumerate(level, 1)}
        for hop in range(1, hops + 1):
            first = {}
            for rank, (n, path) in enumerate(level, 1):
                for kind, other, key in near.get(n, ()):
                    if other not in seen:
                        first[other] = min(first.get(other, (rank, kind, key, (*path, key))), (rank, kind, key, (*path, key)))
            order = sorted(first, key=lambda n: (first[n][0], first[n][1], n, first[n][2]))
            level = [(n, first[n][3]) for n in order]
            seen |= set(order)
            out |= {(q, n, hop, r, p) for r, (n, p) in enumerate(level, 1)}
    return out


def test_walks_like_a_queue(spark):
    rng = random.Random(1)
    edges = [(f"k{i:04d}", rng.choice("ab"), f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for i in range(160)] + [(f"h{i:04d}", "c", "hub", f"x{i}") for i in range(400)] + [("z", "a", "n1", "hub")]
    starts = [(q, f"n{rng.randrange(80)}", o) for q in range(6) for o in range(2)] + [(9, "hub", 0)]
    starts = list({(q, n): (q, n, o) for q, n, o in starts}.values())
    out = T.walked(spark.createDataFrame(starts, "query_id int, node_id string, ordinal int"), spark.createDataFrame(edges, "key string, type string, start_id string, end_id string"), 3)
    got = [(r.query_id, r.node_id, r.hop, r["rank"], tuple(r.path)) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_walk(starts, edges, 3)


def test_one_query_over_everything_runs_in_many_tasks(spark):
    """A level of one query isn't one task: its rows lie in several of the files that the walk wrote."""
    edges = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit("t").alias("type"), F.lit("hub").alias("start_id"), F.concat(F.lit("c"), "id").alias("end_id"))
    out = T.walked(spark.createDataFrame([(1, "hub", 0)], "query_id int, node_id string, ordinal int"), edges, 1)
    assert out.count() == 20_001
    plan = T.queued(out.drop("rank"), ["node_id"])._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_hub_is_expanded_as_far_as_needed(spark):
    """20,000 neighbours and a limit of 50: only the first slices meet chunks, and the ration is the same."""
    reached = spark.range(20_000).selectExpr("1 AS query_id", "CASE WHEN id = 0 THEN 0 ELSE 1 END AS hop", "CASE WHEN id = 0 THEN 1 ELSE id END AS rank", "id AS node")
    reached = reached.unionByName(spark.createDataFrame([(2, 0, 1, 7), (2, 1, 1, 8)], "query_id int, hop int, rank long, node long"))
    joined = []

    def candidates_of(some):  # every node of rank 3k has a chunk
        joined.append(some.count())
        return some.filter("rank % 3 = 0 OR hop = 0").select("query_id", "hop", "node", F.col("rank").alias("place"))

    levels = reached.select("query_id", "hop").distinct()
    rows = lambda df: sorted(map(tuple, df.select("query_id", "hop", "node", "place").collect()))
    some = rows(T.rationed(T.expanded(reached, candidates_of, 50), levels, 50))
    assert sum(joined) <= 50 * 4 + 3 and len(joined) <= 3
    assert some == rows(T.rationed(candidates_of(reached), levels, 50)) and len(some) == 51


def test_levels_without_candidates_end(spark):
    reached = spark.range(1, 1000).selectExpr("1 AS query_id", "1 AS hop", "id AS rank")
    none = T.expanded(reached, lambda some: some.filter("rank < 0").withColumn("place", F.col("rank")), 10)
    assert none.count() == 0


def test_a_walk_writes_numbers(spark, monkeypatch):
    """A hub, eight queries and keys of 1,000 characters: what is written for each node reached doesn't hold the key or the path."""
    from orelode.operators import numbering

    made = []

    def settled(df, **options):
        made.append(old(df, **options))
        return made[-1]

    old = T.settled
    monkeypatch.setattr(T, "settled", settled)
    monkeypatch.setattr(numbering, "settled", settled)
    key = F.concat(F.lit("k" * 1000), F.format_string("%06d", "id"))
    edges = spark.range(500).select(key.alias("key"), F.lit("t").alias("type"), F.lit("hub").alias("start_id"), F.concat(F.lit("c"), "id").alias("end_id"))
    starts = spark.createDataFrame([(q, f"c{q}", 0) for q in range(8)], "query_id int, node_id string, ordinal int")
    out = T.walked(starts, edges, 2)
    for df in made:  # a walk has 8 x 501 rows, edges are there twice
        kinds = dict(df.dtypes)
        assert "query_id" not in kinds or df.count() < 100 or set(kinds.values()) <= {"int", "bigint"}
    got = {(r.query_id, r.node_id): (r.hop, r["rank"], len(r.path)) for r in out.collect()}
    assert len(got) == 8 * 501 and got[3, "hub"] == (1, 1, 1) and got[3, "c0"] == (2, 1, 2) and got[3, "c499"][0] == 2
    assert all(n == hop for hop, _, n in got.values())
