"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

A rule is a predicate over measures of a text. What each rule costs and how much it rejects is estimated on a sample,
and rules run by rejections per second, so that most bad texts meet a cheap rule first and no other. The order decides
the time alone: a text is kept if no rule rejects it.

Windows of eight words are found by 64-bit hashes within a text, and compared by their words where these agree.
"""

from __future__ import annotations

import re
import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, texts that rules are rated on, characters of the longest of them, and how often a rule is timed.
WINDOW, SAMPLE, LONGEST, TIMES = 8, 500, 1 << 16, 3
SPACE = r"[\\x20\\x09-\\x0D]+"
BLANKS = r" \t\n\u000B\f\r"


def words(text: str) -> str:
    return rf"filter(split({text}, '{SPACE}'), w -> w <> '')"


def lines(text: str) -> str:
    return rf"filter(split({text}, '\\n'), l -> length(btrim(l, '{BLANKS}')) > 0)"


def lost(text: str, pattern: str) -> str:
    """Characters that a pattern's removal takes away."""
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '')))"


def window_hashes(words: str) -> str:
    """One hash for each window of eight words; none if there are fewer words."""
    parts = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    one = f"xxhash64({parts})"
    return f"element_at(transform(array(transform({words}, w -> xxhash64(w))), h -> CASE WHEN size(h) < {WINDOW} THEN array() ELSE transform(sequence(0, size(h) - {WINDOW}), i -> {one}) END), 1)"


def repeated_words(hashes: str, words: str) -> str:
    """Words that lie in a window found twice or more, from the windows' hashes and the words.

    Windows whose hash another one has are sorted by their words, so those that really are equal lie side by side.
    """
    pairs = f"sort_array(transform({hashes}, (x, i) -> struct(x AS x, i AS i)))"
    alike = f"element_at(transform(array({pairs}), s -> transform(filter(s, (p, j) -> p.x <=> get(s, j - 1).x OR p.x <=> get(s, j + 1).x), p -> struct(p.x AS x, slice({words}, p.i + 1, {WINDOW}) AS w, p.i AS i))), 1)"
    starts = f"element_at(transform(array(sort_array({alike})), s -> sort_array(transform(filter(s, (p, j) -> p.w <=> get(s, j - 1).w OR p.w <=> get(s, j + 1).w), p -> p.i))), 1)"
    covered = f"aggregate({starts}, named_struct('e', 0, 'n', 0), (a, p) -> named_struct('e', p + {WINDOW}, 'n', a.n + least({WINDOW}, p + {WINDOW} - a.e)), a -> a.n)"
    return f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0 ELSE {covered} END"


def run_words(words: str) -> str:
    """Words equal to the one before."""
    return f"size(filter({words}, (w, i) -> w <=> get({words}, i - 1)))"


#: Measures of a text, from itself and from its words.
MEASURES = {
    "n_words": lambda t, w: f"size({w})",
    "word_chars": lambda t, w: f"length(array_join({w}, ''))",
    "n_symbols": lambda t, w: lost(t, "[#*$%&|<>]"),
    "n_lines": lambda t, w: f"size({lines(t)})",
    "n_dup_lines": lambda t, w: f"size({lines(t)}) - size(array_distinct({lines(t)}))",
    "n_upper": lambda t, w: lost(t, "[A-Z]"),
    "n_lower": lambda t, w: lost(t, "[a-z]"),
    "n_run_words": lambda t, w: run_words(w),
    "n_repeat_words": lambda t, w: f"element_at(transform(array({window_hashes(w)}), v -> {repeated_words('v', w)}), 1)",
}


def with_words(text: str, body: str) -> Column:
    """``body`` with ``ws`` for the words of the text, which are split off once."""
    return F.expr(f"element_at(transform(array({words(text)}), ws -> {body}), 1)")


class Rule(NamedTuple):
    name: str
    needs: tuple[str, ...]
    rejects: str


#: A text that any of these rejects isn't kept. The first two are the base.
RULES = (
    Rule("few words", ("n_words",), "n_words < 20"),
    Rule("repeated words", ("n_repeat_words", "n_words"), "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", ("n_symbols", "n_words"), "10 * n_symbols > n_words"),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), "n_dup_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule("word length", ("word_chars", "n_words", "n_upper", "n_lower"), "word_chars < 2 * n_words OR (word_chars > 20 * n_words AND 2 * (n_upper + n_lower) > word_chars)"),  # scripts without blanks have long words
    Rule("runs of a word", ("n_run_words", "n_words"), "100 * n_run_words > 30 * n_words"),
    Rule("capitals", ("n_upper", "n_lower"), "n_upper > n_lower"),
)
BASE = RULES[:2]


#: Measures that the query's contract asks of every text.
ASKED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rejects(rule: Rule, text: str, words: str = "ws", have: tuple[str, ...] = ()) -> str:
    """The rule over a text and its words; measures in ``have`` are columns."""
    return re.sub(r"[a-z]\w+", lambda m: f"({MEASURES[m[0]](text, words)})" if m[0] in rule.needs and m[0] not in have else m[0], rule.rejects)


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejections per second on the first ``sample`` texts, best first; as given if there are none.

    Texts of over ``LONGEST`` characters aren't in the sample, so that it has a bound on the driver. A rule's time is
    the least of ``TIMES`` runs, less that of a run that only reads the sample.
    """
    spark, name = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    taken = docs.select(name.alias("text")).filter(F.length("text") <= LONGEST).take(sample)
    if not taken:
        return list(rules)
    some = spark.createDataFrame(taken, "text string").coalesce(1).cache()

    def took(predicate: Column) -> tuple[float, int]:
        job, best = some.select(F.count_if(predicate)), float("inf")
        for _ in range(TIMES):
            began = time.perf_counter()
            hits = job.first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    try:
        some.count()
        empty, _ = took(with_words("text", "size(ws) < 0"))
        timed = [took(with_words("text", rejects(rule, "text"))) for rule in rules]
    finally:
        some.unpersist()
    rated = sorted((-(hits + 0.1) / max(s - empty, 1e-3), k) for k, (s, hits) in enumerate(timed))
    return [rules[k] for _, k in rated]


def kept(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text counts as one without words, which the base rejects. Repeated rows stay or go together; columns of any
    name pass through; an empty table gives an empty one.
    """
    name = f"coalesce(`{text}`, '')"
    steps = " ".join(f"WHEN {rejects(rule, name)} THEN false" for rule in cascade(docs, text, sample=sample))
    return docs.filter(with_words(name, f"CASE {steps} ELSE true END"))


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the measures of ``ASKED`` (long), ``base_failed`` and ``kept`` for each row.

    Those measures are taken of every text; what the other rules need is only taken of a text that no rule before
    rejects, in the cascade's order. A null text has no words, symbols or lines. Repeated rows and null keys stay; other
    columns go; an empty table gives an empty one.
    """
    order = cascade(docs, text, tuple(r for r in RULES if not set(r.needs) <= set(ASKED)), sample)
    free = [r for r in RULES if set(r.needs) <= set(ASKED)]
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.expr(words("text")).alias("words"), F.expr(lines("text")).alias("lines"))
    whole = {"n_dup_lines": "size(lines) - size(array_distinct(lines))"}
    plain = [F.expr(whole.get(n) or MEASURES[n]("text", "words")).cast("long").alias(n) for n in ASKED if n != "n_repeat_words"]
    rows = rows.select("doc_id", "text", "words", "lines", *plain, F.expr(window_hashes("words")).alias("hashes"))
    rows = rows.withColumn("n_repeat_words", F.expr(repeated_words("hashes", "words")).cast("long"))
    steps = [f"WHEN {r.rejects} THEN false" for r in (*BASE, *(r for r in free if r not in BASE))]
    steps += [f"WHEN {rejects(r, 'text', 'words', ASKED).replace(MEASURES['n_lines']('text', 'words'), 'size(lines)')} THEN false" for r in order]
    return rows.select("doc_id", *ASKED, F.expr(" OR ".join(f"({r.rejects})" for r in BASE)).alias("base_failed"), F.expr(f"CASE {' '.join(steps)} ELSE true END").alias("kept"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM docs, unnest(range(1, len(words) - 6)) AS u(i)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT r, count(DISTINCT k) AS n FROM twice, unnest(range(i, i + 8)) AS u(k) GROUP BY r
), measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[a-z]')) AS n_lower,
        len(list_filter(words[2:], lambda w, i: w = words[i])) AS n_run_words, coalesce(n, 0) AS n_repeat_words
    FROM docs LEFT JOIN repeats USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines)
        OR word_chars < 2 * n_words OR (word_chars > 20 * n_words AND 2 * (n_upper + n_lower) > word_chars) OR n_upper > n_lower
        OR 100 * n_run_words > 30 * n_words) AS kept
FROM measured
"""
