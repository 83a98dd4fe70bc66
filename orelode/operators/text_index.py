"""Inverted index and BM25 over chunks.

Terms of a chunk are counted within its row, so a stored index's postings come from its rows alone; a search without an
index groups the words of its terms by chunk in a shuffle. Statistics are those of all chunks, whatever a search's
predicate lets through. A search of a stored index reads the buckets that its terms lie in.

A stored index has a term's postings in blocks by their impact, what BM25 makes of them but for the term's own weight:
bands of equal width from the highest possible one down, so a term has ``BANDS`` blocks at most, however common it is,
and no sort or number over its postings is needed. A table of blocks says the highest impact of each. ``block_search``
reads the blocks that a query can need only.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orelode.functions.text import TOKEN, counted, first_seen, tokens
from orelode.session import arrow_task, settled, spread

K1, B = 1.2, 0.75
#: Buckets of a stored index, and query terms up to which they are sent to all tasks.
BUCKETS, SENT = 16, 100_000
#: Bands of impact, and groups that the chunks' terms are stored by.
BANDS, SLOTS = 32, 8
#: Texts whose terms a worker holds at once.
HELD = 500
WORD, PARTED = re.compile(TOKEN), re.compile("[._-]")


class Index(NamedTuple):
    """A stored index.

    ``postings``: ``chunk_id, length, term, tf, block, bucket``, by a hash of their term; ``blocks``: ``term, block, n,
    impact, bucket``; ``forward``: the chunks' terms, ``chunk_id, source, length, terms, slot``.
    """

    postings: DataFrame
    blocks: DataFrame
    forward: DataFrame
    chunks: int
    average: float
    buckets: int
    slots: int

    @property
    def lengths(self) -> DataFrame:
        return self.forward.drop("terms", "slot")


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return chunks.select(F.col(key).alias("chunk_id"), F.size(tokens(F.col(text))).alias("length"))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``chunk_id, length, term, tf``; a chunk id that comes twice has to be dropped before."""
    rows = chunks.select(F.col(key).alias("chunk_id"), tokens(F.col(text)).alias("tokens"))
    return rows.select("chunk_id", F.size("tokens").alias("length"), F.inline(counted(F.col("tokens"))))


def first_chunks(chunks: DataFrame, key: str, order: Column) -> DataFrame:
    """The first chunk of each id."""
    return chunks.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("nth = 1").drop("nth")


def statistics(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """One row: chunks, terms, postings, tokens, and the average length; words are read once."""
    rows = settled(chunks.select(tokens(F.col(text)).alias("tokens")))
    whole = rows.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total_tokens"))
    terms = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return whole.crossJoin(F.broadcast(terms)).withColumn("average_length", F.when(F.col("chunks") > 0, F.round(F.col("total_tokens") / F.col("chunks"), 6)).otherwise(F.lit(0.0)))  # a row each


def source_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by source."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")


def document_frequencies(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    return postings(chunks, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Distinct terms of each query, with their place of first sight."""
    return queries.select(F.col(key).alias("query_id"), F.posexplode(first_seen(tokens(F.col(text)))).alias("place", "term"))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def impact(tf: Column, length: Column, average: float, k1: float = K1, b: float = B) -> Column:
    """What BM25 makes of a posting, but for its term's weight."""
    return (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.greatest(length, F.lit(1)) / F.lit(average if average > 0 else 1.0)))


def weight(df: Column, chunks: int) -> Column:
    """A term's own weight."""
    return F.log1p((F.lit(chunks) - df + 0.5) / (df + 0.5))


def term_counts(text: str) -> Counter:
    """How often a text in lower case has each term, as ``tokens`` has them."""
    out = Counter(WORD.findall(text))
    for word, n in [x for x in out.items() if not x[0].isalnum()]:
        for part in PARTED.split(word):
            out[part] += n
    return out


def counted_batches(batches):
    """The rows with ``length, terms``, an array of (term, tf) by term, in place of ``words``, their text in lower case."""
    for batch in batches:
        for rows in (batch.slice(k, HELD) for k in range(0, len(batch), HELD)):
            lengths, ends, terms, tfs = [], [0], [], []
            for text in rows.column("words"):
                counts = term_counts(text.as_py())
                own = sorted(counts)
                lengths.append(counts.total())
                terms += own
                tfs += [counts[t] for t in own]
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
            rest = rows.drop_columns(["words"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], [*rest.schema.names, "length", "terms"])


def save(chunks: DataFrame, path: str, buckets: int = BUCKETS, key: str = "chunk_id", text: str = "text", bands: int = BANDS, slots: int = SLOTS) -> None:
    """Writes the index of chunks below ``path``: their words are read once, and no term's postings go through one task.

    Buckets and slots say how finely a search can choose what to read, not how many tasks write or read them: a large one
    is split over files.
    """
    source = [c for c in ("source",) if c in chunks.columns]
    rows = spread(chunks.select(F.col(key).alias("chunk_id"), *source, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("words")))
    kinds = [f"{c} {kind}" for c, kind in rows.dtypes if c != "words"]
    rows = rows.mapInArrow(arrow_task(__name__, "counted_batches"), ", ".join([*kinds, "length int", "terms array<struct<term:string,tf:int>>"])).withColumn("slot", bucket(F.col("chunk_id").cast("string"), slots))
    rows.sortWithinPartitions("slot", "chunk_id").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/forward")  # from where they are: a file for each task and slot
    rows = chunks.sparkSession.read.schema(rows.schema).parquet(f"{path}/forward")
    n, average = rows.agg(F.count(F.lit(1)), F.avg("length")).first()
    own = rows.select("chunk_id", "length", F.inline("terms")).withColumn("bucket", bucket(F.col("term"), buckets))
    band = F.floor((1 - impact(F.col("tf"), F.col("length"), average or 0.0) / (K1 + 1)) * bands)
    placed = own.withColumn("block", F.greatest(F.lit(0), F.least(band, F.lit(bands - 1))).cast("int"))
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    highest = F.max(impact(F.col("tf"), F.col("length"), average or 0.0)).alias("impact")
    blocks = _stored(chunks.sparkSession, path, "postings", dict(chunks.dtypes)[key], n).groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("n"), highest)
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    totals = chunks.sparkSession.createDataFrame([(n, float(average or 0.0), buckets, slots, dict(chunks.dtypes)[key])], "chunks long, average double, buckets int, slots int, kind string")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def _stored(spark, path: str, name: str, kind: str, chunks: int) -> DataFrame:
    """A part of a stored index; that of no chunks has no files."""
    schema = {"postings": f"chunk_id {kind}, length int, term string, tf int, block int, bucket int", "blocks": "term string, block int, n long, impact double, bucket int"}[name]
    return spark.read.schema(schema).parquet(f"{path}/{name}") if chunks else spark.createDataFrame([], schema)


def load(spark, path: str) -> Index:
    """A stored index; one that isn't there is an error."""
    totals = spark.read.parquet(f"{path}/totals").first()
    forward = spark.read.parquet(f"{path}/forward") if totals.chunks else spark.createDataFrame([], f"chunk_id {totals.kind}, length int, terms array<struct<term:string,tf:int>>, slot int")
    stored = [_stored(spark, path, name, totals.kind, totals.chunks) for name in ("postings", "blocks")]
    return Index(*stored, forward, totals.chunks, totals.average, totals.buckets, totals.slots)


def index_report(index: Index) -> DataFrame:
    """Chunks, terms, postings, tokens and the average length of a stored index, and its chunks by source."""
    terms = index.blocks.groupBy("term").agg(F.sum("n").alias("df")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    per = index.lengths.groupBy("source").agg(F.count(F.lit(1)).alias("n")) if "source" in index.lengths.columns else index.lengths.select(F.lit("").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = per.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    whole = index.lengths.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"), F.round(F.coalesce(F.avg("length"), F.lit(0.0)), 6).alias("average_length"))
    return whole.crossJoin(F.broadcast(terms)).crossJoin(F.broadcast(sources))  # a row each


def asked_postings(chunks: DataFrame, terms: DataFrame, key: str, text: str) -> tuple[DataFrame, int, float]:
    """Postings of these terms, the number of chunks, and their average length: words are read once."""
    rows = settled(chunks.select(F.col(key).alias("chunk_id"), tokens(F.col(text)).alias("tokens")))
    n, average = rows.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    some = rows.select("chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(terms, "term")
    return some.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf")), n, average or 0.0


def scores(chunks: DataFrame | None, queries: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B, index: Index | None = None) -> DataFrame:
    """``query_id, chunk_id, score``: BM25, rounded to six places; over a stored index if one is given, else over chunks."""
    asked = settled(query_terms(queries))
    terms = asked.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= SENT else terms
    if index is None:
        some, n, average = asked_postings(chunks, terms, key, text)
    else:
        n, average = index.chunks, index.average
        wanted = [r[0] for r in terms.select(bucket(F.col("term"), index.buckets)).distinct().collect()]  # a row for each bucket at most
        some = index.postings.filter(F.col("bucket").isin(wanted)).drop("bucket", "block").join(terms, "term")
    some = settled(some)  # read twice
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "term").select("query_id", "term", weight(F.col("df"), n).alias("idf"))
    part = F.col("idf") * impact(F.col("tf"), F.col("length"), average, k1, b)
    hits = some.join(weighed, "term").select("query_id", "chunk_id", part.alias("part"))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))


def with_matched(found: DataFrame, chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Adds ``matched``, the query's terms that a chunk has, in order: for the few chunks of a result, not for all scored."""
    rows = found.join(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("chunk_text")), "chunk_id")
    rows = rows.join(queries.select("query_id", first_seen(tokens(F.col("text"))).alias("asked")), "query_id")
    return rows.withColumn("matched", F.array_sort(F.array_intersect("asked", tokens(F.col("chunk_text"))))).drop("chunk_text", "asked")


def top(scored: DataFrame, limit: int, admitted: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` chunks of each query, ties by chunk id; of those in ``admitted`` (chunk_id) if given."""
    if admitted is not None:
        scored = scored.join(admitted.select("chunk_id").distinct(), "chunk_id", "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)


def match_kinds(found: DataFrame, chunks: DataFrame, identifiers: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Adds ``match_kind`` and ``named``: identifiers (query_id, ids) that a chunk has as a whole token, in their order."""
    rows = found.join(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("chunk_text")), "chunk_id").join(identifiers.select("query_id", "ids"), "query_id", "left")
    own = F.array_distinct(tokens(F.col("chunk_text")))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    named = F.element_at(F.transform(F.array(own), lambda o: F.filter(ids, lambda i: F.array_contains(o, F.lower(i)))), 1)  # a text's words once, not for each id
    rows = rows.withColumn("named", named).drop("chunk_text", "ids")
    return rows.withColumn("match_kind", F.when(F.size("named") > 0, "exact_identifier").otherwise("lexical"))
