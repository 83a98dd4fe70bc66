import hashlib
import random

import pytest
from pyspark.sql import functions as F

from orelode.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "INST]", "|im_end|>", "\n", "a", "é", "😀", "<\\|im_end|>", "[\\\\/INST]", "s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible():
    rng = random.Random(1)
    seen = {}
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        made = chat.escape(text)
        assert not any(c in made for c in chat.CONTROLS)
        assert chat.unescape(made) == text and seen.setdefault(made, text) == text
        role = chat.escape_role(text)
        assert "\n" not in role and not any(c in role for c in chat.CONTROLS) and chat.unescape_role(role) == text


def test_formats_and_reads_back():
    rng = random.Random(2)
    for _ in range(2000):
        turns = [("".join(rng.choice(PARTS) for _ in range(rng.randrange(4))) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(6))]
        text, mask = chat.format_turns(turns, ("assistant",))
        assert chat.turns_of(text) == turns
        assert [chat.unescape(text[s["start"] : s["end"]]) for s in mask] == [t for r, t in turns if r == "assistant"]
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns)
    for bad in ("x", chat.OPEN, f"{chat.OPEN}user\nx", f"{chat.OPEN}user\nx{chat.CLOSE}"):
        with pytest.raises(ValueError):
            chat.turns_of(bad)


def plain_paths(rows, top):
    """Every root-to-leaf path by a walk from the roots."""
    ids = {r[1] for r in rows}
    score, tree = {r[1]: r[3] or 0.0 for r in rows}, {r[1]: r[0] for r in rows}
    below = {}
    for _, i, parent, _ in rows:
        below.setdefault(parent if parent in ids else None, []).append(i)
    found, stack = {}, [[i] for i in below.get(None, [])]
    while stack:
        path = stack.pop()
        if path[-1] in below:
            stack += [[*path, c] for c in below[path[-1]]]
        else:
            found.setdefault(tree[path[-1]], []).append((-sum(score[i] for i in path) / len(path), -len(path), path[-1], path))
    return {(t, p[2], k + 1, d, i) for t, own in found.items() for k, p in enumerate(sorted(own)) if top is None or k < top for d, i in enumerate(p[3])}


@pytest.mark.parametrize("top", [1, 3, None])
def test_paths_like_a_walk(spark, top):
    rng = random.Random(4)
    rows, tree_of = [], {}
    for i in range(400):
        parent = rng.choice([None, 10_000 + i, *(rng.randrange(i) for _ in range(8))] if i else [None])
        tree_of[i] = tree_of.get(parent, rng.choice(["a", "b", None]))
        rows.append((tree_of[i], i, parent, rng.choice([None, 1.0, 0.5, 2.0])))
    rows += [("chain", 1000 + k, 999 + k if k else None, 1.0) for k in range(130)] + [("star", 2000 + k, 2000 if k else None, float(k % 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double")
    out = chat.paths(df, top).select("tree", "leaf", "rank", "depth", "id").collect()
    assert len(out) == len(set(map(tuple, out))) and set(map(tuple, out)) == plain_paths(rows, top)


def test_best_branches(spark):
    rows = [("t", 0, None, 0.0, "user", "q"), ("t", 1, 0, 5.0, "assistant", "good"), ("t", 2, 0, 1.0, "assistant", "poor"), ("t", 3, 1, None, "user", "ok"), ("u", 9, None, 0.0, None, None)]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string").withColumns({"Leaf": F.lit(1), "rank": F.lit("x")})
    out = chat.read_back(chat.conversations(df, top=1)).collect()
    assert {(r.tree, r.leaf, r["rank"], tuple(r.role), tuple(r.text), tuple(r.learned)) for r in out} == {("t", 3, 1, ("user", "assistant", "user"), ("q", "good", "ok"), ("good",)), ("u", 9, 1, ("",), ("",), ())}
    assert chat.conversations(df, top=None).count() == 3


def test_cycles_are_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        chat.paths(spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0), ("t", 3, None, 0.0)], "tree string, id long, parent long, score double"))


def plain(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in [*groups.items(), (-1, [(True, 0, "user", "</s>[INST] ok [/INST]"), (True, 1, "assistant", "</s>[INST] ok [/INST]")])]:
        own = sorted(own)
        learned = "".join(t for *_, r, t in own if r == "assistant")
        out.append((conv, len(own), sha("".join(f"{r}\n{t}\n" for *_, r, t in own)), len(learned), sha(learned), len(chat.format_turns([(r, t) for *_, r, t in own], chat.LEARNED)[0])))
    return out


def test_query_like_a_plain_version(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, 0, 1, 2, -1]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", None, ""]), rng.choice([None, "", "x" * 50_000, *("".join(rng.choice(PARTS) for _ in range(6)) for _ in range(9))])) for _ in range(120)]
    rows += rows[:20] + [(77, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op13_chat(spark, str(tmp_path))
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(rows)))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op13_chat(spark, str(tmp_path)).collect()] == [-1]
