"""Exact top-k of one batch of queries in one reading of the chunks, without an index.

1. A task counts the words of its chunks, and keeps those that a query asks for, by number, with the chunk's length.
2. Frequencies of these terms and the average length come from what was kept.
3. A task scores its own chunks for all queries and hands on the best ``limit`` of each query only, so what is shuffled
   is tasks times queries times ``limit`` rows, whatever the corpus.

An index costs a shuffle of all postings and pays when many batches follow; this costs each batch one reading of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.operators import text_index as X
from orelode.operators.text_index import term_counts
from orelode.session import arrow_task, settled, spread

#: Pairs of a chunk and a query's term that are scored at once, if each chunk had them all.
AT_ONCE = 4_000_000


def kept_batches(batches, terms: pa.Array):
    """``chunk_id, length, terms, tfs`` of chunks (chunk_id, words): the asked terms by their place in ``terms``."""
    number = {t: k for k, t in enumerate(terms.to_pylist())}
    for batch in batches:
        lengths, ends, own, tfs = [], [0], [], []
        for text in batch.column("words"):
            counts = term_counts(text.as_py())
            lengths.append(counts.total())
            for k, term in sorted((number[t], t) for t in counts.keys() & number.keys()):  # so sums have one order, and copies one score
                own.append(k)
                tfs.append(counts[term])
            ends.append(len(own))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (own, tfs)]
        yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(lengths, pa.int64()), *lists], ["chunk_id", "length", "terms", "tfs"])


def scored(rows: pa.RecordBatch, starts: np.ndarray, asking: np.ndarray, idf: np.ndarray, average: float, queries: int) -> np.ndarray:
    """The score of each row (chunk) and query, 0 where no term is shared; ``asking[starts[t]:starts[t + 1]]`` ask for term t."""
    lists = rows.column("terms")
    at = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    term, tf = lists.flatten().to_numpy(zero_copy_only=False), rows.column("tfs").flatten().to_numpy(zero_copy_only=False)
    length = np.maximum(rows.column("length").to_numpy(zero_copy_only=False), 1)[at]
    part = idf[term] * (tf * (X.K1 + 1)) / (tf + X.K1 * (1 - X.B + X.B * length / (average if average > 0 else 1.0)))
    many = starts[term + 1] - starts[term]
    of = np.repeat(np.arange(len(term)), many)
    query = asking[np.arange(len(of)) + np.repeat(starts[term] - (np.cumsum(many) - many), many)]
    return np.bincount(at[of] * queries + query, part[of], len(rows) * queries).reshape(len(rows), queries)


def best_batches(batches, ids: pa.Array, starts: np.ndarray, asking: np.ndarray, idf: np.ndarray, average: float, limit: int):
    """``query_id, chunk_id, score`` of the best ``limit`` chunks of each query among these, ties by chunk id."""
    least = np.full(len(ids), -1.0)  # the score that a chunk must have
    step, kept = max(1, AT_ONCE // max(1, len(asking))), None
    for batch in batches:
        for rows in (batch.slice(k, step) for k in range(0, len(batch), step)):
            found = scored(rows, starts, asking, idf, average, len(ids))
            rounded = np.floor(found * 1e6 + 0.5) / 1e6
            at, query = np.nonzero((found > 0) & (rounded >= least))
            if not len(at):
                continue
            new = pa.table({"query": query, "chunk_id": rows.column("chunk_id").take(pa.array(at)), "score": rounded[at, query]})
            kept = new if kept is None else pa.concat_tables([kept, new])
            kept = kept.take(pc.sort_indices(kept, [("query", "ascending"), ("score", "descending"), ("chunk_id", "ascending")], null_placement="at_start"))
            query = kept.column("query").to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == limit - 1
            least[query[last]] = kept.column("score").to_numpy()[last]
            kept = kept.filter(pa.array(place < limit)).combine_chunks()
    if kept is not None:
        yield from kept.set_column(0, "query_id", ids.take(kept.column("query").combine_chunks())).to_batches()


def search(chunks: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the best ``limit`` chunks of each query, ties by chunk id.

    The same as scoring all pairs, which is what is done where queries have over ``SENT`` terms together. A chunk id that
    comes twice has to be dropped before. Queries without a term of the chunks have no rows.
    """
    asked = settled(X.query_terms(queries).select("query_id", "term"))
    if asked.count() > X.SENT:
        return X.top(X.scores(chunks, queries, key, text), limit)
    told = asked.toArrow()  # SENT rows at most
    query, term = (told.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
    ids, terms = query.dictionary, term.dictionary
    of, asking = np.divmod(np.unique(term.indices.to_numpy().astype("int64") * len(ids) + query.indices.to_numpy()), max(1, len(ids)))
    starts = np.searchsorted(of, np.arange(len(terms) + 1))
    texts = chunks.select(F.col(key).alias("chunk_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    kind = dict(texts.dtypes)["chunk_id"]
    rows = settled(spread(texts).mapInArrow(arrow_task(__name__, "kept_batches", terms=terms), f"chunk_id {kind}, length long, terms array<int>, tfs array<int>"))
    n, average = rows.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = rows.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = np.zeros(len(terms))
    for number, weight in df.select("number", X.weight(F.col("df"), n)).collect():  # a row for each asked term at most
        idf[number] = weight
    task = arrow_task(__name__, "best_batches", ids=ids, starts=starts, asking=asking, idf=idf, average=average or 0.0, limit=limit)
    return X.top(rows.mapInArrow(task, f"query_id {dict(asked.dtypes)['query_id']}, chunk_id {kind}, score double"), limit)
