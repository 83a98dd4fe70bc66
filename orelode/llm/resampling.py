"""Importance resampling towards a target: documents whose word n-grams look like the target's are drawn.

Features are all runs of up to ``n`` words, hashed into buckets. Each task gives its batches to a DuckDB of its own:
SQL unnests the words, a window makes the n-grams, and a registered function takes their CRC. What comes back is
spilled to Parquet by Spark: a row for each document with its buckets, and one for each task with its bucket counts.
Spark adds these up, and scores the documents from the spilled buckets, so texts are read once. Only bucket counts, as
many as there are buckets, come to the driver. The draw is a row number over ranges, not a window.

Texts of over ``PIECE`` characters go to DuckDB in pieces that are cut between words and begin with the last words of
the piece before, so all n-grams are there once, however long a text is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.llm.merkle import SQL_CRC, SQL_CRC_OF
from orelode.llm.runtime import fresh, task, values, written
from orelode.operators.numbering import numbered

#: Words of lower-cased texts: runs of ASCII letters, digits, and all characters beyond ASCII. A fixed value.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in texts as they are, and what lies between words.
_WORD, _BREAK = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Characters of a piece of a long text, characters that DuckDB gets at a time, and its memory.
PIECE, AT_ONCE, MEMORY = 1 << 18, 4 << 20, "400MB"


def crc(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Unsigned CRC-32 of each text's bytes, read where they lie."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset).tolist()
    data, of = memoryview(data) if data else b"", zlib.crc32
    return pa.array(np.fromiter((of(data[a:b]) for a, b in pairwise(places)), np.int64, len(texts)))


def pieces(text: str, n: int, size: int) -> Iterator[tuple[int, str]]:
    """A text in pieces of about ``size`` characters, each with the number of words that it repeats from before."""
    at, carried = 0, []
    while True:
        cut = _BREAK.search(text, at + size) if len(text) > at + size else None
        own = text[at : cut.start() if cut else len(text)]
        yield len(carried), " ".join([*carried, own])
        if cut is None:
            return
        carried = [*carried, *_WORD.findall(own)][-(n - 1) :] if n > 1 else []
        at = cut.start()


def feature_sql(n: int, buckets: int) -> str:
    """``row, k, bucket`` of every run of k words that a piece doesn't repeat."""
    nexts = ", ".join(f"lead(word, {k}) OVER piece AS word{k}" for k in range(1, n))
    runs = [f"SELECT row, {k} AS k, {' || chr(32) || '.join(['word', *(f'word{j}' for j in range(1, k))])} AS feature FROM windowed WHERE place + {k} > carried" + (f" AND word{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, n + 1)]
    return f"""
        WITH words AS (SELECT row, piece, carried, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM texts),
        flat AS (SELECT row, piece, carried, unnest(words) AS word, unnest(range(len(words))) AS place FROM words),
        windowed AS (SELECT row, carried, word, place{", " + nexts if nexts else ""} FROM flat WINDOW piece AS (PARTITION BY row, piece ORDER BY place))
        SELECT row, k, (crc(feature) % {buckets})::INTEGER AS bucket FROM ({" UNION ALL ".join(runs)})
    """


def portions(batch: pa.RecordBatch, n: int, size: int, at_once: int) -> Iterator[pa.Table]:
    """The pieces of a batch's texts as tables of bounded size."""
    rows, held = [], 0

    def made():
        columns = zip(*rows, strict=True)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["row", "piece", "carried", "text"])

    for i, text in enumerate(values(batch, "text")):
        for k, (carried, piece) in enumerate(pieces(text or "", n, size)):
            rows.append((i, k, carried, piece))
            held += len(piece)
            if held > at_once:
                yield made()
                rows, held = [], 0
    if rows:
        yield made()


def spill(batches, n: int, buckets: int, size: int, at_once: int = AT_ONCE):
    """Documents with their words' number and buckets, and at the end the buckets' counts."""
    con = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if con is None:
            con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
            con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
            con.execute("CREATE TABLE counts (bucket INTEGER, n BIGINT)")
        n_words, parts = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
        for table in portions(batch, n, size, at_once):
            con.register("texts", table)
            con.execute(f"CREATE OR REPLACE TEMP TABLE features AS {feature_sql(n, buckets)}")
            con.execute("INSERT INTO counts SELECT bucket, count(*) FROM features GROUP BY bucket")
            found = con.sql("SELECT row, count(*) FILTER (k = 1) AS n_words, list(bucket) AS buckets FROM features GROUP BY row").to_arrow_table().combine_chunks()
            con.unregister("texts")
            lists = found.column("buckets")
            for i, (row, words) in enumerate(zip(found.column("row").to_pylist(), found.column("n_words").to_pylist(), strict=True)):
                n_words[row] += words
                parts[row].append(lists[i].values)
        offsets = [0, *accumulate(sum(map(len, p)) for p in parts)]
        flat = pa.concat_arrays([x for p in parts for x in p]) if offsets[-1] else pa.array([], pa.int32())
        yield _rows(batch.column("doc"), n_words, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), None)
    if con is not None:
        counted = con.execute("SELECT bucket, sum(n)::BIGINT FROM counts GROUP BY bucket ORDER BY bucket").fetchall()
        yield _rows(pa.nulls(1, batch.column("doc").type), None, None, [[{"bucket": b, "n": k} for b, k in counted]])
        con.close()


def _rows(doc, n_words, buckets, counts) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())])))
    columns = [pa.nulls(len(doc), kind) if c is None else pa.array(c, kind) if isinstance(c, list) else c for c, kind in zip((n_words, buckets, counts), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([doc, *columns], names=["doc", "n_words", "buckets", "counts"])


def spilled(docs: DataFrame, key: str, text: str, n: int, buckets: int, piece: int = PIECE) -> DataFrame:
    """``doc, n_words, buckets`` for each row and ``counts`` for each task, as a table in the shared folder."""
    doc, own = fresh(docs, "doc", "text_of_doc")
    rows = docs.select(F.col(key).alias(doc), F.col(text).alias(own)).withColumnsRenamed({doc: "doc", own: "text"})
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_words long, buckets array<int>, counts array<struct<bucket:int,n:long>>"
    return written(rows.mapInArrow(task(__name__, "spill", n=n, buckets=buckets, size=piece), schema))


def bucket_counts(spilled: DataFrame, buckets: int) -> list[int]:
    """How many features are in each bucket, of all tasks."""
    rows = spilled.filter("counts IS NOT NULL").select(F.inline("counts")).groupBy("bucket").agg(F.sum("n")).collect()  # a row for each bucket at most
    out = [0] * buckets
    for b, n in rows:
        out[b] = n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """What a feature of each bucket adds: 1000 times the logarithm of its share in the target by that in all documents.

    Every bucket has one more feature than it has, so none has a share of 0.
    """
    all_raw, all_target, m = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_raw + m) / (float(s + 1) * float(all_target + m)))) for s, t in zip(raw, target, strict=True)]


def floored(whole: Column, n: Column) -> Column:
    """The quotient of longs, rounded down."""
    some = F.greatest(n, F.lit(1))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", whole - F.pmod(whole, some), some))


def noise(seed: int, key: str) -> Column:
    """1000 times a Gumbel variate of the key, rounded down: the highest sums of weights and noise are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 7, piece: int = PIECE) -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row; ``rank`` is null for those that aren't drawn.

    ``percent`` of the rows with ``least_words`` or more are drawn, by the highest scores, ties by key (nulls first).
    A null text has no words: weight 0, never drawn. Repeated rows are rows each, with ranks of their own; a null key
    has the noise of an empty one. Without a target, or of an empty one, gains come from the documents alone. An empty
    table gives an empty one. Other columns, of any name, are left out.
    """
    own = spilled(docs, key, text, n, buckets, piece)
    theirs = spilled(target.select(F.lit(0).alias("doc"), target_text), "doc", target_text, n, buckets, piece)
    made = gains(bucket_counts(own, buckets), bucket_counts(theirs, buckets))
    table = F.split(F.lit(",".join(map(str, made))), ",").cast("array<long>")
    rows = own.filter("counts IS NULL").select("doc", "n_words", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda whole, b: whole + F.get(table, b)).alias("whole"))
    rows = rows.select("doc", "n_features", (F.col("n_words") >= least_words).alias("enough"), floored(F.col("whole"), F.col("n_features")).alias("weight"))
    rows = written(rows.withColumn("score", F.col("weight") + noise(seed, "doc")))
    drawn = percent * rows.filter("enough").count() // 100
    out = numbered(rows, [], [F.desc("enough"), F.desc("score"), "doc"], "place")
    return out.select(F.col("doc").alias(key), "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def sql(percent: int = 25, buckets: int = 10_000, least_words: int = 20, seed: int = 7) -> str:
    """The same for bigrams in DuckDB, over ``documents`` and ``benchmark``."""
    features = "list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH {SQL_CRC.strip()},
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
own AS MATERIALIZED (SELECT r, unnest({features}) AS feature FROM docs),
theirs AS MATERIALIZED (SELECT unnest({features}) AS feature FROM (SELECT {words} AS words FROM benchmark)),
hashed AS MATERIALIZED (SELECT feature, {SQL_CRC_OF.format("feature")} % {buckets} AS bucket FROM (SELECT feature FROM own UNION SELECT feature FROM theirs), bits),
s AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM theirs JOIN hashed USING (feature) GROUP BY bucket),
gain AS MATERIALIZED (
    SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + {buckets}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM theirs) + {buckets}))))::BIGINT AS gain
    FROM range({buckets}) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
summed AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS whole FROM own JOIN hashed USING (feature) JOIN gain USING (bucket) GROUP BY r),
weighed AS (
    SELECT r, doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (whole - (whole % n + n) % n) // n ELSE 0 END AS weight,
           floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
    FROM docs LEFT JOIN summed USING (r)
),
drawn AS (
    SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM weighed WHERE n_words >= {least_words}
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank
FROM weighed LEFT JOIN drawn USING (r)
"""
