"""Where results go: index and graph tables, batches for an outside store, and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from orelode.operators import text_index


def guarded(path: str, corpus_root: str) -> str:
    """``path``, unless it lies within the raw corpus."""
    if f"{path.rstrip('/')}/".startswith(f"{corpus_root.rstrip('/')}/"):
        raise ValueError(f"{path} lies within the corpus")
    return path


def save_index(chunks: DataFrame, path: str, corpus_root: str, buckets: int = text_index.BUCKETS) -> None:
    """The text index of chunks, outside the raw corpus: postings by a hash of their term, so a search reads few files."""
    text_index.save(chunks, guarded(path, corpus_root), buckets)


#: What a store keeps of nodes and edges besides their identity.
NODE_COLUMNS, EDGE_COLUMNS = ("node_id", "node_type", "source", "source_id", "canonical_id", "name", "properties", "evidence"), ("key", "type", "start_id", "end_id", "evidence")


def merge_statement(kind: str, namespace: str) -> str:
    """The statement that merges one batch of rows by their identity; all that it writes carries the namespace."""
    if not namespace.replace("_", "").isalnum():
        raise ValueError(f"{namespace!r} is no name")
    if kind == "nodes":
        return f"UNWIND $rows AS row MERGE (n:{namespace} {{node_id: row.node_id}}) SET n += row.values, n.namespace = '{namespace}'"
    if kind == "edges":
        return f"UNWIND $rows AS row MATCH (a:{namespace} {{node_id: row.start_id}}), (b:{namespace} {{node_id: row.end_id}}) MERGE (a)-[e:RELATED {{key: row.key}}]->(b) SET e += row.values, e.namespace = '{namespace}'"
    raise ValueError(f"{kind!r} are neither nodes nor edges")


def merge_rows(rows: list[dict], kind: str) -> list[dict]:
    """Rows as a statement's parameter: identity, and flat values without nulls."""
    out = []
    for row in rows:
        flat = {k: v for k, v in row.items() if not isinstance(v, dict)} | {k: v for m in (row.get("properties"), row.get("evidence")) for k, v in (m or {}).items()}
        values = {k: v for k, v in flat.items() if v is not None}
        out.append({"node_id": row["node_id"], "values": values} if kind == "nodes" else {"key": row["key"], "start_id": row["start_id"], "end_id": row["end_id"], "values": values})
    return out


def merged_into(nodes: DataFrame, edges: DataFrame, session: Callable[[], Callable[[str, list], None]], namespace: str, size: int = 1000) -> None:
    """Merges a graph into an outside store, nodes before edges; ``session`` makes a client that runs a statement with rows."""
    for kind, rows, columns in (("nodes", nodes, NODE_COLUMNS), ("edges", edges, EDGE_COLUMNS)):
        statement = merge_statement(kind, namespace)

        def writer(kind=kind, statement=statement):
            run = session()
            return lambda held: run(statement, merge_rows(held, kind))

        batched(rows.select(*[c for c in columns if c in rows.columns]), writer, size)


def batched(rows: DataFrame, writer: Callable[[], Callable[[list], None]], size: int = 1000) -> None:
    """Hands rows to an outside store in batches from each partition; ``writer`` makes a client there.

    Writers must be idempotent (merge by key), as a partition may run again.
    """

    def send(part: Iterable) -> None:
        client, held = writer(), []
        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                client(held)
                held = []
        if held:
            client(held)

    rows.foreachPartition(send)


def report(values: dict, volatile: tuple[str, ...] = ("generated_at", "latency")) -> tuple[str, str]:
    """A report as JSON with sorted keys, and the same without what changes from run to run."""
    stable = {k: v for k, v in values.items() if k not in volatile}
    return json.dumps(values, sort_keys=True, indent=2), json.dumps(stable, sort_keys=True, indent=2)


def evaluation_payload(tables: dict[str, DataFrame], **facts) -> dict:
    """An evaluation's report as one document: its small tables as lists of rows, and facts such as its version and times."""
    return facts | {name: sorted((r.asDict(recursive=True) for r in rows.collect()), key=str) for name, rows in tables.items()}


def evaluation_markdown(payload: dict) -> str:
    """The payload's tables, one section each, and its plain facts before them."""
    facts = [(k, v) for k, v in sorted(payload.items()) if not isinstance(v, list)]
    out = [markdown("Evaluation", ["fact", "value"], facts)]
    for name, rows in sorted((k, v) for k, v in payload.items() if isinstance(v, list)):
        columns = sorted({c for r in rows for c in r})
        out.append(markdown(name, columns or ["(none)"], [tuple(r.get(c, "") for c in columns) for r in rows]))
    return "\n".join(out)


def markdown(title: str, columns: list[str], rows: list[tuple]) -> str:
    head = [f"# {title}", "", f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
    return "\n".join([*head, *(f"| {' | '.join(map(str, r))} |" for r in rows)]) + "\n"
