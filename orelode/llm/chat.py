"""Conversations from reply trees, formatted for training with a loss mask, and read back.

Messages name their parents. Iterative self-joins enumerate the paths: on round k each message knows its ancestor
2**k above and the sum of scores up to it, so trees of depth d take log2(d) rounds, whatever their width. Leaves are
ranked by the mean score of their path within their tree; for the chosen ones the same tables of ancestors give the
rows of each path, again by doubling. Only ids go through these joins; texts join the finished paths once.

A formatted conversation is one string:

    <|im_start|>role
    text<|im_end|>

for each turn. Control strings inside roles and texts are escaped: a backslash goes after their first character, and
what already has backslashes there gets one more, so that taking one away gives back the text, and no control string is
left in it. In roles, backslashes and line ends are escaped before. The loss mask is the spans of assistant texts, in
code points of the formatted string.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import blank, task, values, written
from orelode.operators.numbering import numbered

#: The template's own marks. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings that no text may hold unescaped: the template's, and those of other common ones. Fixed values.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Each begins with a character that it doesn't have again, so no two occurrences overlap.
_BY_HEAD = {head: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == head) for head in sorted({c[0] for c in CONTROLS})}
_HELD = re.compile("|".join(rf"{re.escape(head)}(?=\\*(?:{tails}))" for head, tails in _BY_HEAD.items()))
_ESCAPED = re.compile("|".join(rf"{re.escape(head)}\\(?=\\*(?:{tails}))" for head, tails in _BY_HEAD.items()))

#: Characters of finished conversations that a task holds.
FLUSH = 4 << 20
LEARNED = ("assistant",)
MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return _HELD.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def climbed(messages: DataFrame) -> list[DataFrame]:
    """Tables ``id, up, total, n`` for k = 0, 1, 2 ...: the ancestor 2**k above (null if there is none), and the sum of
    scores and the number of messages below it, each from the message itself on. ``messages``: id, parent, score.
    """
    ids = messages.select(F.col("id").alias("known"))
    own = ("id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n"))
    under = messages.filter("parent IS NOT NULL").join(ids, F.col("parent") == F.col("known"), "left").withColumn("up", F.col("known"))
    roots = messages.filter("parent IS NULL").withColumn("up", F.col("parent"))  # else nulls would meet in one task
    tables = [written(under.select(*own).unionByName(roots.select(*own)))]
    open_before = None
    while (still := tables[-1].filter("up IS NOT NULL").count()) > 0:
        if still == open_before:  # a round closes some message as long as any has a root
            raise ValueError(f"{still} messages never reach a root: parents form a cycle")
        open_before = still
        low, high = tables[-1], tables[-1].select(F.col("id").alias("at"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("n").alias("m"))
        # a message that has reached its root needs no join, so keys are those of messages with open ends only
        done, going = low.filter("up IS NULL"), low.filter("up IS NOT NULL")
        went = going.join(high, F.col("up") == F.col("at")).select("id", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        tables.append(written(done.unionByName(went)))
    return tables


def paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """``tree, leaf, rank, depth, id``: a row for each message of each chosen path, depth 0 at the root.

    ``messages``: tree, id (unique, not null), parent (null, or of no message: a root), score (null: 0). Leaves are
    messages that are no parent. Rank 1, 2 ... within a tree: the higher mean score, then the longer path, then the
    lesser id. ``top``: only paths of a rank up to it. An empty table gives an empty one; a cycle is an error.
    """
    own = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    tables = climbed(own)
    leaves = tables[-1].join(own.select(F.col("parent").alias("p")).filter("p IS NOT NULL").distinct(), F.col("id") == F.col("p"), "left_anti")
    leaves = leaves.join(messages.select("tree", "id"), "id").select("tree", F.col("id").alias("leaf"), (-F.col("total") / F.col("n")).alias("worse"), (-F.col("n")).alias("shorter"), "n")
    ranked = numbered(written(leaves), ["tree"], ["worse", "shorter", "leaf"], "rank").withColumn("rank", F.col("rank") + 1)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    found = ranked.select("tree", "leaf", "rank", (F.col("n") - 1).alias("depth"), F.col("leaf").alias("id"))
    for k, jumps in enumerate(tables[:-1]):  # with these rows the nearest 2**k messages of each path are there
        found = written(found)
        more = found.join(jumps.filter("up IS NOT NULL").select(F.col("id").alias("at"), "up"), F.col("id") == F.col("at"))
        found = found.unionByName(more.select("tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("id")))
    return found


def format_turns(turns, learned: tuple[str, ...]) -> tuple[str, list[dict]]:
    """The string of (role, text) pairs, and its mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role in learned:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, CLOSE, "\n")
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; an error if it is none."""
    out, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(f"{CLOSE}\n", line + 1)
        if not text.startswith(OPEN, at) or line < 0 or end < 0:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(text[at + len(OPEN) : line]), unescape(text[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return out


def format_paths(batches, learned: tuple[str, ...]):
    """A row for each run of rows of one path, with the other columns as its first row has them."""
    done, first, turns, size = [], None, [], 0

    def flush():
        nonlocal size
        firsts, texts, masks = zip(*done, strict=True)
        whole = pa.Table.from_batches(firsts).combine_chunks()
        done.clear()
        size = 0
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in whole.columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(masks, MASK)], names=[*whole.schema.names, "formatted", "loss"])

    path = None
    for batch in batches:
        keep = batch.select([c for c in batch.schema.names if c not in ("depth", "role", "text")])
        for i, (own, role, text) in enumerate(zip(batch.column("path_id").to_pylist(), values(batch, "role"), values(batch, "text"), strict=True)):
            if turns and own != path:
                done.append((first, *format_turns(turns, learned)))
                turns, size = [], size + len(done[-1][1])
                if size > FLUSH:
                    yield flush()
            if not turns:
                path, first = own, pa.RecordBatch.from_arrays([pa.array(c.slice(i, 1).to_pylist(), c.type) for c in keep.columns], schema=keep.schema)
            turns.append((role, text))
    if turns:
        done.append((first, *format_turns(turns, learned)))
    if done:
        yield flush()


def formatted(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Turns (path_id, depth, role, text, others) as ``path_id``, the others, ``formatted`` and ``loss``.

    Null roles and texts are empty. A path's rows go to one task, in order, and leave it as one row: a conversation must
    fit into a row, no more.
    """
    others = [f for f in turns.schema if f.name not in ("path_id", "depth", "role", "text")]
    rows = turns.select("path_id", *[f.name for f in others], "depth", blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.repartition("path_id").sortWithinPartitions("path_id", "depth")
    schema = ", ".join(["path_id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "formatted string, loss array<struct<start:long,end:long>>"])
    return rows.mapInArrow(task(__name__, "format_paths", learned=learned), schema)


def read_batches(batches):
    """Batches are bounded in bytes, or are one row."""
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in ("formatted", "loss")]
        roles, texts, learned, sizes = [], [], [], []
        for text, mask in zip(values(batch, "formatted"), values(batch, "loss"), strict=True):
            turns = turns_of(text)
            roles.append([r for r, _ in turns])
            texts.append([t for _, t in turns])
            learned.append([unescape(text[s["start"] : s["end"]]) for s in mask])
            sizes.append(len(text))
        made = [pa.array(v, pa.list_(pa.string())) for v in (roles, texts, learned)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made, pa.array(sizes, pa.int64())], names=[*keep, "role", "text", "learned", "formatted_chars"])


def read_back(rows: DataFrame) -> DataFrame:
    """What formatted conversations say: ``role`` and ``text`` arrays by turn, and ``learned``, the texts under the mask."""
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("formatted", "loss")]
    schema = ", ".join([*keep, "role array<string>", "text array<string>", "learned array<string>", "formatted_chars long"])
    return rows.mapInArrow(task(__name__, "read_batches"), schema)


def chained(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Linear conversations (key, turn, role, text) as reply trees: ``tree, id, parent, score``, with role, text and place.

    Every row is a message and answers the one before it: by turn (nulls first), then role, text. So repeated rows and
    turns that come twice are turns each. A null key is a conversation of its own. Ids are places among all rows.
    """
    rows = written(conversations.select(F.col(key).alias("tree"), "turn", blank("role").alias("role"), blank("text").alias("text")))
    order = ["tree", "turn", "role", "text"]
    rows = numbered(rows, [], order, "id")
    starts = rows.groupBy("tree").agg(F.min("id").alias("id"), F.lit(True).alias("first"))
    marked = rows.join(starts.select("id", "first"), "id", "left")
    return marked.select("tree", "id", F.when(F.col("first").isNull(), F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def conversations(messages: DataFrame, top: int | None = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``tree, leaf, rank, formatted, loss`` for the best ``top`` paths of each reply tree (None: all of them).

    ``messages``: tree, id, parent, score, role, text; see ``paths`` and ``formatted``. Other columns are left out.
    """
    messages = written(messages.select("tree", "id", "parent", "score", "role", "text"))
    chosen = written(paths(messages, top))
    turns = chosen.join(messages.select("id", "role", "text"), "id").select("tree", "leaf", "rank", F.col("leaf").alias("path_id"), "depth", "role", "text")
    return formatted(turns, learned).select("tree", "leaf", "rank", "formatted", "loss")


def _sql_escaped(text: str) -> str:
    starts = {c: [x for x in CONTROLS if x[0] == c] for c in {x[0] for x in CONTROLS}}
    for c, own in sorted(starts.items()):
        tails = "|".join(re.sub(r"([\[\]|/])", r"\\\1", x[1:]) for x in own)
        head = re.sub(r"([\[\]])", r"\\\1", c)
        text = rf"regexp_replace({text}, '{head}(\\*)({tails})', '{c}\\\1\2', 'g')"
    return text


SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
    UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]', true FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
),
turns AS (
    SELECT *, length({_sql_escaped("text")}) AS text_chars,
           length({_sql_escaped(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) AS role_chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(role_chars + text_chars + {len(OPEN) + len(CLOSE) + 2})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, added
"""
