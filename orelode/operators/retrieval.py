"""Retrieval as a whole: text route, graph route, merge, filter, rank, for a batch of queries in one plan.

Queries have ``query_id, text, entity_ids, canonical_fields, lexical_fields, sources, sections``; empty arrays of
sources and sections filter nothing. Chunks have ``chunk_id, record_id, source, section, text, chunk_ord``; nodes
``node_id, record_id, canonical_id`` and the columns of their identifiers; edges ``key, type, start_id, end_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import first_seen, folded, stripped
from orelode.operators import block_search as S
from orelode.operators import ranking as R
from orelode.operators import text_index as X
from orelode.operators import traverse as T
from orelode.session import settled

MODES = ("text", "graph", "hybrid")
CANDIDATES, TOP = 200, 10


def checked(queries: DataFrame) -> DataFrame:
    """Queries; one that states no text, entities or fields is an error."""
    said = (stripped("text") != "") | (F.size("entity_ids") > 0) | (F.size("canonical_fields") > 0)
    return queries.filter(F.when(said, True).otherwise(F.raise_error(F.format_string("query %s states nothing", F.col("query_id").cast("string"))).cast("boolean")))


def admits() -> Column:
    """Whether a query's filter lets a chunk through; empty arrays filter nothing."""
    return ((F.size("sources") == 0) | F.array_contains("sources", F.col("source"))) & ((F.size("sections") == 0) | F.array_contains("sections", F.col("section")))


def text_route(queries: DataFrame, chunks: DataFrame, limit: int = CANDIDATES, index: X.Index | None = None) -> DataFrame:
    """Candidates by BM25 over the text, the entities and the lexical fields (else the canonical ones).

    What a filter leaves out is left out of the scored pairs, by key: no chunk meets a query that it shares no term with.
    """
    lexical = F.when(F.size("lexical_fields") > 0, F.col("lexical_fields")).otherwise(F.col("canonical_fields"))
    asked = queries.select("query_id", F.concat_ws(" ", "text", F.concat_ws(" ", "entity_ids"), F.concat_ws(" ", lexical)).alias("text"))
    filters = queries.filter((F.size("sources") > 0) | (F.size("sections") > 0)).select("query_id", "sources", "sections", F.lit(True).alias("filtered"))

    def admitted(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(filters, "query_id", "left")
        met = rows.filter("filtered").join(chunks.select("chunk_id", "source", "section"), "chunk_id").filter(admits())
        return rows.filter("filtered IS NULL").select(pairs.columns).unionByName(met.select(pairs.columns))

    if index is None:
        best = X.top(admitted(settled(X.scores(chunks, asked))), limit)
    else:
        best = S.search(index, asked, limit, admitted).drop("matched")
    named = queries.select("query_id", first_seen(F.concat("entity_ids", "canonical_fields")).alias("ids"))
    found = X.match_kinds(settled(best), chunks, named)
    return found.select("query_id", "chunk_id", R.evidence("text", F.col("match_kind"), F.col("score"), F.lit(None), F.col("named")).alias("evidence"))


def graph_route(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], limit: int = CANDIDATES, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Candidates of walks from the named nodes, rationed by hop; and the reports of all seeds."""
    asked = queries.select("query_id", F.posexplode(F.concat("entity_ids", "canonical_fields")).alias("ordinal", "value"))
    reports = settled(T.seeds(asked, T.identifier_index(nodes, identifiers)))
    starts = T.start_nodes(reports)
    reached = settled(T.walked(starts, edges, hops))
    own = F.filter(F.transform(F.array(*[F.col(c).cast("string") for c in identifiers if c != "name"]), lambda v: F.lower(stripped(v))), lambda v: v.isNotNull())
    named = nodes.select("node_id", "record_id", "canonical_id", own.alias("own"))
    held = chunks.select("record_id", "chunk_id", "chunk_ord", "source", "section")

    def candidates_of(some: DataFrame) -> DataFrame:
        rows = some.join(named, "node_id").join(starts.select("query_id", "node_id", "value"), ["query_id", "node_id"], "left")
        rows = rows.join(held, "record_id").join(queries.select("query_id", "sources", "sections"), "query_id").filter(admits())
        return rows.withColumn("place", F.struct("rank", "chunk_ord", "chunk_id"))

    rows = T.expanded(reached, candidates_of, limit)
    some = T.rationed(rows, reached.select("query_id", "hop").distinct(), limit)
    kind = R.match_kind(F.col("hop"), F.coalesce("value", F.lit("")), F.col("own"))
    matched = F.when(kind == "exact_identifier", F.array_distinct(F.array("value", "canonical_id"))).otherwise(F.array("canonical_id"))
    return some.select("query_id", "chunk_id", R.evidence("graph", kind, 1.0 / (1 + F.col("hop")), F.col("hop"), matched).alias("evidence")), reports


def routes(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], limit: int, hops: int = 2, index: X.Index | None = None, modes: tuple[str, ...] = MODES) -> tuple[DataFrame, DataFrame]:
    """Candidates of both routes, each computed once (or none, where no mode asks for it)."""
    none = chunks.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(chunks.dtypes)['chunk_id']}, evidence {R.EVIDENCE[6:-1]}")
    text = settled(text_route(queries, chunks, limit, index)) if set(modes) != {"graph"} else none
    graph = settled(graph_route(queries, chunks, nodes, edges, identifiers, limit, hops)[0]) if set(modes) != {"text"} else none
    return text, graph


def ranked(mode: str, text: DataFrame, graph: DataFrame, queries: DataFrame, chunks: DataFrame, top: int = TOP, limit: int = CANDIDATES) -> DataFrame:
    """One mode's ranking of the routes' candidates."""
    rows = settled(R.merged(text if mode != "graph" else text.limit(0), graph if mode != "text" else graph.limit(0))).join(chunks.select("chunk_id", "record_id", "source", "section"), "chunk_id")
    rows = rows.join(queries.select("query_id", F.col("entity_ids").alias("identifiers"), F.col("canonical_fields").alias("fields")), "query_id")
    names = F.transform("fields", lambda f: folded(f))
    place = F.array_min(F.filter(F.transform(F.flatten(F.transform("evidence", lambda e: e.matched)), lambda m: F.array_position(names, folded(m))), lambda p: p > 0))
    return R.ranked(R.scored(rows.withColumn("named_at", place)), top, limit).drop("identifiers", "fields", "named_at")


def retrieved(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], mode: str = "hybrid", top: int = TOP, limit: int = CANDIDATES, hops: int = 2, index: X.Index | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, record_id, source, section, total, evidence`` and the parts of the score."""
    if mode not in MODES or top <= 0:
        raise ValueError(f"mode {mode!r} or top {top} isn't known")
    queries = checked(queries)
    text, graph = routes(queries, chunks, nodes, edges, identifiers, max(limit, top), hops, index, (mode,))
    return ranked(mode, text, graph, queries, chunks, top, limit)


def modes(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], depth: int = 120, index: X.Index | None = None) -> DataFrame:
    """Rankings of all modes (mode, case_id, position, record_id), chunks standing for their records; the routes run once."""
    queries, out = checked(queries), None
    text, graph = routes(queries, chunks, nodes, edges, identifiers, max(CANDIDATES, depth), index=index)
    for mode in MODES:
        rows = ranked(mode, text, graph, queries, chunks, depth).select(F.lit(mode).alias("mode"), F.col("query_id").alias("case_id"), F.col("rank").alias("position"), "record_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def post_filtered(results: DataFrame, sources: tuple[str, ...] = (), sections: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Results that a filter lets through, and for each query how many it took away."""
    lets = (F.col("source").isin(*sources) if sources else F.lit(True)) & (F.col("section").isin(*sections) if sections else F.lit(True))
    return results.filter(lets), results.groupBy("query_id").agg(F.count_if(~lets).alias("removed"))


def redirect_groups(reports: DataFrame) -> DataFrame:
    """``query_id, successor, originals``: which withdrawn identifiers led to one, each once in the order asked."""
    first = reports.filter("status = 'redirected'").groupBy("query_id", "successor", "value").agg(F.min("ordinal").alias("o"))
    return first.groupBy("query_id", "successor").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "value"))), lambda x: x["value"]).alias("originals"))


def methods(evidence: Column) -> Column:
    """The distinct methods of an item's evidence, text before graph."""
    return F.filter(F.array(F.lit("text"), F.lit("graph")), lambda m: F.exists(evidence, lambda e: e.method == m))


def problems(results: DataFrame, known: DataFrame) -> DataFrame:
    """``ranking.problems``, items without a method, and items that can't be traced (``record_id, source`` and, where the
    chunks have them, ``source_id, location``)."""
    plain = R.problems(results, known)
    there = [c for c in ("source_id", "location") if c in known.columns]
    rows = results.join(known.select("chunk_id", *there), "chunk_id", "left")
    lacks = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c) for c in ("record_id", "source", *there)]))
    codes = F.array_compact(F.array(F.when(F.size(methods(F.col("evidence"))) == 0, "no_method"), F.when(F.size(lacks) > 0, "incomplete_provenance")))
    return plain.unionByName(rows.select(F.explode(codes).alias("code"), "query_id", "chunk_id"))


def flattened(results: DataFrame) -> DataFrame:
    """``query_id, chunk_id, provenance, score`` as maps of strings: what an item says to the outside."""
    walks = F.filter("evidence", lambda e: e.method == "graph")
    named = lambda of: F.array_join(F.array_distinct(F.flatten(F.transform(of, lambda e: e.matched))), ",")
    made = {"record_id": F.col("record_id"), "source": F.col("source"), "section": F.col("section"), "methods": F.array_join(methods(F.col("evidence")), ","), "matched": named(F.col("evidence")), "hops": F.array_min(F.transform(walks, lambda e: e.hops)).cast("string"), "match_kinds": F.array_join(F.array_distinct(F.transform("evidence", lambda e: e.match_kind)), ",")}
    parts = [c for c in results.columns if c.startswith("score_")]
    entries = lambda pairs: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull())
    score = entries([("total", F.format_string("%.6f", "total")), *[(p[6:], F.format_string("%.6f", F.col(p))) for p in parts]])
    return results.select("query_id", "rank", "chunk_id", entries(list(made.items())).alias("provenance"), score.alias("score"))


class Service:
    """What is built once and asked often: chunks, graph and a stored index of one corpus, below ``path``."""

    def __init__(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], path: str):
        self.spark, self.path, self.identifiers = chunks.sparkSession, path, identifiers
        for name, rows in (("chunks", chunks), ("nodes", nodes), ("edges", edges)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        self.chunks, self.nodes, self.edges = (self.spark.read.parquet(f"{path}/{n}") for n in ("chunks", "nodes", "edges"))
        X.save(self.chunks, f"{path}/index")
        self.index = X.load(self.spark, f"{path}/index")

    def report(self) -> DataFrame:
        """What the index holds, its records, and the graph's nodes."""
        records = self.chunks.agg(F.countDistinct("record_id").alias("records"))
        return X.index_report(self.index).crossJoin(F.broadcast(records)).crossJoin(F.broadcast(self.nodes.agg(F.count(F.lit(1)).alias("graph_nodes"))))

    def chunks_of(self, records: DataFrame) -> DataFrame:
        """All chunks of records (record_id), in their order."""
        return self.chunks.join(records.select("record_id").distinct(), "record_id", "left_semi").orderBy("record_id", "chunk_ord")

    def for_queries(self, queries: DataFrame, mode: str = "hybrid", top: int = TOP) -> DataFrame:
        return retrieved(queries, self.chunks, self.nodes, self.edges, self.identifiers, mode, top, index=self.index)

    def for_rules(self, asked: DataFrame, mode: str = "hybrid", top: int = TOP) -> DataFrame:
        """Of what rules ask (``query_planning.rule_queries`` with ``rule_id, text``)."""
        none = F.array().cast("array<string>")
        return self.for_queries(asked.select(F.col("rule_id").cast("string").alias("query_id"), "text", "entity_ids", "canonical_fields", "lexical_fields", none.alias("sources"), none.alias("sections")), mode, top)

    def for_requirements(self, rows: DataFrame, mode: str = "hybrid", top: int = TOP) -> DataFrame:
        """Of requirements (request_id, requirement): their text alone."""
        none = F.array().cast("array<string>")
        return self.for_queries(rows.select(F.col("request_id").cast("string").alias("query_id"), F.col("requirement").alias("text"), *[none.alias(c) for c in ("entity_ids", "canonical_fields", "lexical_fields", "sources", "sections")]), mode, top)
