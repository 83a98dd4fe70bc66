"""A Merkle manifest of a dataset: each row is a leaf, each group of rows a tree, and the groups' roots a tree above.

Superblock reduction: the rows of a group are numbered (by ranges, without a window), and a bucket is ``index //
fanout**levels``. One call of ``applyInPandas`` collapses the ``levels`` levels of a bucket and returns its root and the
lower part of each node's proof; the buckets' roots are the nodes of the next round, until each group has one. Proofs
are put together from the top: a bucket's upper part goes to its ``fanout**levels`` nodes at most, so no join has a hot
key, however large a group is.

A bucket needs no count of its group: one that isn't full and is its group's first is the only one, and stops at one
node; any other collapses all its levels, as its group has more nodes on each of them.

A node is the lowercase hex SHA-256 of its children's hex digests; the last run may be shorter, and a run of one is
hashed like any other. A lone leaf is its group's root.
"""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import ROOT, fresh, written
from orelode.operators.numbering import numbered

FANOUT, LEVELS = 2, 8
PROOF = "left array<binary>, right array<binary>"
NO_STEPS = "cast(array() as array<binary>)"


def field(name: str | Column) -> Column:
    """A value as a leaf has it: ``-`` if null, else its bytes' number, a colon, and the value."""
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*fields: str | Column) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def parents(nodes: list[bytes], fanout: int) -> list[bytes]:
    hexed = [n.hex() for n in nodes]
    return [hashlib.sha256("".join(hexed[i : i + fanout]).encode()).digest() for i in range(0, len(nodes), fanout)]


def collapse(pdf: pd.DataFrame, fanout: int, levels: int) -> pd.DataFrame:
    """A bucket's nodes with their proofs up to the bucket's root."""
    pdf = pdf.sort_values("at", ignore_index=True)
    level = [bytes(n) for n in pdf["node"]]
    steps, first = [], int(pdf["at"].iloc[0])
    only = first == 0 and len(level) < fanout**levels
    while len(level) > 1 or not only and len(steps) < levels:
        steps.append(level)
        level = parents(level, fanout)
    left, right = [], []
    for i in range(len(pdf)):
        before, after = [], []
        for j, nodes in enumerate(steps):
            own = i // fanout**j
            run = own - own % fanout
            before.append(b"".join(nodes[run:own]))
            after.append(b"".join(nodes[own + 1 : run + fanout]))
        left.append(before)
        right.append(after)
    return pd.DataFrame({"tree": pdf["tree"], "at": pdf["at"], "bucket": first // fanout**levels, "left": left, "right": right, "root": level[0]})


def climbed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The rounds of a reduction, each ``tree, at, bucket, left, right, root``, of nodes (tree string not null, at long
    from 0 without gaps, node binary). The last round has a bucket for each tree, and its root is the tree's.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("a run has two nodes or more, and a bucket one level or more")
    width, rounds = fanout**levels, []
    root = ROOT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if root not in sys.path:
            sys.path.insert(0, root)
        from orelode.llm.merkle import collapse

        return collapse(pdf, fanout, levels)

    while not rounds or not rounds[-1].filter("bucket > 0").isEmpty():
        grouped = nodes.select("tree", "at", "node").groupBy("tree", F.floor(F.col("at") / width).alias("b"))
        rounds.append(written(grouped.applyInPandas(run, f"tree string, at long, bucket long, {PROOF}, root binary")))
        nodes = rounds[-1].filter(F.col("at") % width == 0).select("tree", F.col("bucket").alias("at"), F.col("root").alias("node"))
    return rounds


def descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``tree, at, left, right`` and what else ``above`` has, for each node of the first round.

    ``above`` (tree, at, left, right ...) is what comes above the last round's buckets; each of its rows, and of those of
    the rounds on the way down, goes to one bucket's nodes only.
    """
    more = [c for c in above.columns if c not in ("tree", "at", "left", "right")]
    for lower in reversed(rounds):
        upper = above.select(F.col("tree").alias("t"), F.col("at").alias("b"), F.col("left").alias("ul"), F.col("right").alias("ur"), *more)
        both = lower.drop("root").join(upper, (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("b")))
        above = both.select("tree", "at", F.concat("left", "ul").alias("left"), F.concat("right", "ur").alias("right"), *more)
    return above


def roots(rounds: list[DataFrame]) -> DataFrame:
    return rounds[-1].filter("at = 0").select("tree", F.col("root").alias("node"))


def folded(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    text = lambda digests: F.lower(F.hex(digests))
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda own, s: F.sha2(F.concat(text(s["l"]), own, text(s["r"])), 256))


def siblings_digest(left: Column, right: Column) -> Column:
    """SHA-256 of all siblings' hex digests, level by level, left to right."""
    steps = F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda s: F.lower(F.hex(F.concat(s["l"], s["r"]))))
    return F.sha2(F.array_join(steps, ""), 256)


def manifest(docs: DataFrame, key: str, fields: list[str], group: str, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``key, leaf, subroot, root, left, right`` for each row (and ``tampered_leaf``, of the leaf digest ``tampered``).

    A leaf covers ``fields``, each with its length, so that values can't flow into one another. Leaves of a ``group``
    ascend by ``key`` (nulls first), those of one key by their digest; equal rows are leaves each, and any of them may
    have any of their places. Null groups are a group of their own, the first. Groups ascend by bytes. Texts of any
    length are hashed whole; an empty table gives an empty one. Columns may have any other names.
    """
    own_leaf, own_tampered, tree, node, at = fresh(docs, "leaf", "tampered_leaf", "tree", "node", "at")
    rows = docs.select(F.col(key), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias(tree), F.unhex(leaf(*fields)).alias(own_leaf), F.unhex(tampered if tampered is not None else F.lit(None).cast("string")).alias(own_tampered))
    rows = written(rows.withColumnsRenamed({key: "key", tree: "tree", own_leaf: "node", own_tampered: "tampered"}))
    rows = numbered(rows, ["tree"], ["key", "node"], "at")
    rounds = climbed(rows, fanout, levels)
    tops = numbered(roots(rounds), [], ["tree"], "at").select(F.col("tree").alias("of"), F.lit("").alias("tree"), "at", "node")
    upper = climbed(tops, fanout, levels)
    whole = roots(upper).select("tree", F.lit(0).cast("long").alias("at"), F.expr(NO_STEPS).alias("left"), F.expr(NO_STEPS).alias("right"), F.col("node").alias("root"))
    groups = tops.join(descended(upper, whole), ["tree", "at"])
    groups = groups.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "left", "right", F.col("node").alias("subroot"), "root")
    out = rows.join(descended(rounds, groups), ["tree", "at"])
    text = lambda c: F.lower(F.hex(c))
    more = [text("tampered").alias("tampered_leaf")] if tampered is not None else []
    return out.select(F.col("key").alias(key), text("node").alias("leaf"), *more, text("subroot").alias("subroot"), text("root").alias("root"), "left", "right")


#: crc32 of a text, by a table (of one row, to be joined) that is made from its polynomial.
SQL_CRC = """
bits AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS made FROM range(256) r(i))
"""
SQL_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || hex(encode({0}))[2 * i - 1:2 * i])::BIGINT)), lambda c, b: xor(c >> 8, made[(xor(c, b) & 255) + 1])), 4294967295)"

_TREE = """
{name} AS (
    SELECT tree, 0 AS level, pos, n, h FROM {leaves}
    UNION ALL
    SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
{name}_steps AS (
    SELECT own.key, own.level, CASE WHEN s.h IS NULL THEN 'N' WHEN s.pos < own.pos THEN 'L' || s.h ELSE 'R' || s.h END AS step
    FROM (SELECT l.key, l.tree, g.level, l.pos >> g.level AS pos FROM {leaves} l, LATERAL (SELECT unnest(range(coalesce((SELECT max(level) FROM {name} x WHERE x.tree = l.tree), 0))) AS level) g) own
    LEFT JOIN {name} s ON s.tree = own.tree AND s.level = own.level AND s.pos = xor(own.pos, 1)
),
{name}_proofs AS (SELECT l.key, coalesce(list(p.step ORDER BY p.level) FILTER (p.step IS NOT NULL), []) AS steps FROM {leaves} l LEFT JOIN {name}_steps p USING (key) GROUP BY l.key)"""

_FIELD = "coalesce(octet_length(encode(({0})::VARCHAR)) || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")) + ")"

SQL = f"""
WITH RECURSIVE {SQL_CRC.strip()},
rows AS MATERIALIZED (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format(n_chars="n_chars")} AS h,
           CASE WHEN n_chars IS NOT NULL AND {SQL_CRC_OF.format("coalesce(doc_id::VARCHAR, '')")} % 7 = 0 AND doc_id IS NOT NULL THEN {_LEAF.format(n_chars="n_chars + 1")} END AS tampered
    FROM documents, bits
),
leaves AS MATERIALIZED (SELECT row_number() OVER () AS key, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows),
{_TREE.format(name="lower_nodes", leaves="leaves").strip()},
tops AS MATERIALIZED (SELECT tree AS key, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, h FROM lower_nodes WHERE n = 1),
{_TREE.format(name="upper_nodes", leaves="tops").strip()},
proofs AS (
    SELECT l.*, t.h AS subroot, (SELECT h FROM upper_nodes WHERE n = 1) AS root, list_concat(p.steps, q.steps) AS steps
    FROM leaves l JOIN lower_nodes_proofs p ON p.key = l.key JOIN tops t ON t.key = l.tree JOIN upper_nodes_proofs q ON q.key = l.tree
),
done AS (
    SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
           list_reduce(list_prepend(coalesce(tampered, h), steps), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root
    FROM proofs
)
SELECT *, folded_root = root AS verified FROM done
"""
