"""The cascade against plain Python."""

import random
import re
from collections import Counter

from orelode.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)),
        "n_run_words": sum(a == b for a, b in zip(words, words[1:])), "n_repeat_words": len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}),
    }
    base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    bad = base or 10 * m["n_symbols"] > m["n_words"] or (m["n_dup_lines"] > 3 and 2 * m["n_dup_lines"] > m["n_lines"]) or m["word_chars"] < 2 * m["n_words"] or (m["word_chars"] > 20 * m["n_words"] and 2 * (m["n_upper"] + m["n_lower"]) > m["word_chars"]) or m["n_upper"] > m["n_lower"] or 100 * m["n_run_words"] > 30 * m["n_words"]
    return m | {"base_failed": base, "kept": not bad}


def rows():
    rng = random.Random(4)
    some = [" ".join(rng.choices([f"word{i}" for i in range(k)], k=n)) for k in (2, 9, 300) for n in (5, 19, 20, 60, 400)]
    some += [None, "", "  \n\t ", "\n\n", "a b c d e f g h\n" * 6, "x" * 900, "é b\x0bc\x85 \x0c d", ("one two three four five six seven eight " * 3) + " ".join(map(str, range(40))), "BIG! " * 30, " ".join("漢字" * (15 + i) for i in range(25)), " ".join("long" * (9 + i) for i in range(25)), "# a| " * 30, " lead and trail \n same\n same\nsame\n"]
    return [(i if i != 3 else None, t, "x") for i, t in enumerate(some + some[:3])]


def test_measures(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, `words` string")
    got = quality.measured(docs).collect()
    key = lambda x: str(sorted(x.items()))
    asked = lambda t: {k: v for k, v in plain(t).items() if k in (*quality.ASKED, "base_failed", "kept")}
    assert sorted((r.asDict() for r in got), key=key) == sorted(({"doc_id": d} | asked(t) for d, t, _ in rows()), key=key)
    kept = quality.kept(docs).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if plain(r.text)["kept"])
    assert quality.measured(docs.limit(0)).collect() == [] and quality.kept(docs.limit(0)).collect() == []


def test_no_python(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, extra string")
    for df in (quality.measured(docs), quality.kept(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_cheap_rules_first(spark):
    docs = spark.createDataFrame([(i, "too few") for i in range(200)], "doc_id long, text string")
    assert [r.name for r in quality.cascade(docs)][-1] != "few words"
    assert sorted(quality.cascade(docs)) == sorted(quality.RULES)


def test_windows_whose_hashes_agree(spark):
    """Equal hashes alone make no repeat: the words decide."""
    docs = spark.createDataFrame([(t or "",) for _, t, _ in rows()], "text string").selectExpr("text", f"{quality.words('text')} AS words")
    docs = docs.selectExpr("text", "words", f"{quality.window_hashes('words')} AS hashes").selectExpr("text", "words", "transform(hashes, h -> h % 2) AS hashes")
    for r in docs.selectExpr("text", f"{quality.repeated_words('hashes', 'words')} AS n").collect():
        assert r.n == plain(r.text)["n_repeat_words"]


def test_long_texts_are_not_sampled(spark):
    docs = spark.createDataFrame([(1, "x " * 70_000), (2, None)], "doc_id long, text string")
    assert sorted(quality.cascade(docs)) == sorted(quality.RULES)
    assert sorted(quality.cascade(docs.filter("doc_id = 1"))) == sorted(quality.RULES)
