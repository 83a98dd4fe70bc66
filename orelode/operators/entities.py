"""Entities of rules: nested values, fields with their values in queries, routes by field name, and shapes in text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V
from orelode.operators.mapping import split_field
from orelode.session import arrow_task

#: Shapes that are read from text: fixed values. Longer digests go first.
SHAPES = {
    "url": ("network", r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+"),
    "ip_address": ("network", r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b"),
    "file_hash": ("file", r"\b(?:[A-Fa-f0-9]{64}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{32})\b"),
    "registry_key": ("registry", r"(?i)(?:HKLM|HKCU|HKCR|HKU|HKCC|HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKEY_CLASSES_ROOT|HKEY_USERS|HKEY_CURRENT_CONFIG|\\REGISTRY\\[A-Za-z]+)[\\/][^\s\"']*"),
}
#: The atoms of a query: literals, parentheses, separators, names, white space, and single characters of all else. What a
#: name, a separator, a literal and a keyword is, the query language fixes.
ATOM = re.compile(r"""(?P<literal>"(?:[^"\\]|\\.)*")|(?P<paren>[()])|(?P<space>\s+)|(?P<separator>==|!=|:)|(?P<name>[A-Za-z_@][A-Za-z0-9_.@\-]*)|(?P<other>.)""", re.DOTALL)
BARE = re.compile(r"[^\s()]+")
KEYWORDS = {"and", "or", "not"}
PAIR = "array<struct<field:string,value:string,location:string>>"
PAIRS = pa.list_(pa.struct([("field", pa.string()), ("value", pa.string()), ("location", pa.string())]))


class Atoms:
    """A query as a list of (kind, text, place), with what can be read from a place on."""

    def __init__(self, query: str):
        self.query = query
        self.items = [(m.lastgroup, m[0], m.start()) for m in ATOM.finditer(query)]

    def kind(self, i: int) -> str:
        return self.items[i][0] if i < len(self.items) else "end"

    def solid(self, i: int) -> int:
        """The first atom from ``i`` on that isn't white space."""
        return i + 1 if self.kind(i) == "space" else i

    def clauses(self):
        """(name, its place, the value's first atom) for each name before a separator; the receiver says where to go on."""
        i = 0
        while i < len(self.items):
            after = self.solid(i + 1)
            if self.kind(i) != "name" or self.kind(after) != "separator":
                i += 1
                continue
            first = self.solid(after + 1)
            if self.kind(first) == "name" and self.items[first][1].lower() == "not":
                first = self.solid(first + 1)
            to = yield self.items[i][1], self.items[i][2], first
            i = to or after + 1

    def group(self, i: int) -> tuple[list[str], int]:
        """Members of the group that opens at ``i``, and the atom behind it; no atom if the group doesn't end."""
        depth, members, joined = 0, [], False
        for j in range(i, len(self.items)):
            kind, text, _ = self.items[j]
            if kind == "paren":
                depth += 1 if text == "(" else -1
                joined = False
                if not depth:
                    return [m[1:-1] if len(m) > 1 and m[0] == m[-1] == '"' else m for m in members if m.lower() not in KEYWORDS], j + 1
            elif kind == "space":
                joined = False
            elif joined:
                members[-1] += text
            else:
                members.append(text)
                joined = True
        return [], 0

    def values(self, i: int) -> tuple[list[str], int]:
        """What is stated from atom ``i`` on, and the atom behind it."""
        kind, text, place = self.items[i] if i < len(self.items) else ("end", "", 0)
        if kind == "literal":
            return [text[1:-1]], i + 1
        if text == "(":
            return self.group(i)
        if kind == "end" or text == '"' or not (m := BARE.match(self.query, place)):
            return [], 0
        while i < len(self.items) and self.items[i][2] < m.end():
            i += 1
        return [m[0]], i


def pairs(query: str) -> list[dict]:
    """Fields and the values stated for them; a clause that doesn't end states none."""
    atoms, out = Atoms(query), []
    clauses, to = atoms.clauses(), None
    while True:
        try:
            name, place, first = clauses.send(to)
        except StopIteration:
            return out
        values, to = ([], None) if name.lower() in KEYWORDS else atoms.values(first)
        to = to if values else None
        out += [{"field": name, "value": v, "location": f"detection.query[{place}]" + (f"[{k}]" if k else "")} for k, v in enumerate(values)]


def leaves(value, field: str, path: str) -> list[dict]:
    """Scalars of a nested value in document order, with the nearest key as their field."""
    if isinstance(value, list) and value and isinstance(value[0], tuple) or value == ():
        return [x for k, v in value or () for x in leaves(v, k, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaves(v, field, f"{path}[{i}]")]
    return [] if value is None or isinstance(value, bool) else [{"field": field, "value": str(value), "location": path}]


def pair_batches(batches, column: str):
    for batch in batches:
        yield batch.append_column("pairs", pa.array([pairs(t or "") for t in batch.column(column).to_pylist()], PAIRS))


def leaf_batches(batches, column: str):
    for batch in batches:
        got = [leaves(json.loads(t, object_pairs_hook=lambda p: list(dict(p).items()) or ()), "", "detection") if t else [] for t in batch.column(column).to_pylist()]
        yield batch.append_column("pairs", pa.array(got, PAIRS))


def _with_pairs(rows: DataFrame, function: str, column: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInArrow(arrow_task(__name__, function, column=column), f"{schema}, pairs {PAIR}")
    return made.select(*rows.columns, F.posexplode("pairs").alias("n", "p")).select(*rows.columns, "n", "p.field", "p.value", "p.location")


def query_pairs(rows: DataFrame, column: str = "query") -> DataFrame:
    """``rows`` with ``n, field, value, location`` for each pair that their query states."""
    return _with_pairs(rows, "pair_batches", column)


def nested_values(rows: DataFrame, column: str = "detection") -> DataFrame:
    """``rows`` with ``n, field, value, location`` for each scalar of their JSON text."""
    return _with_pairs(rows, "leaf_batches", column)


def routed(occurrences: DataFrame, field: str = "field") -> DataFrame:
    """Occurrences by what their field name says: ``extractor, entity_type``; a field may have several routes."""
    spark = occurrences.sparkSession
    routes = F.broadcast(spark.createDataFrame(V.routes(), "route string, extractor string, entity_type string"))  # a fixed table of under 200 rows
    return occurrences.withColumn("route", F.lower(stripped(split_field(F.col(field))[0]))).join(routes, "route").drop("route")


def shapes(scopes: DataFrame, text: str = "text", field: str | None = None, kinds: tuple[str, ...] = tuple(SHAPES)) -> DataFrame:
    """``scopes`` with ``entity_type, extractor, n, value`` for each shape in their text.

    Where a field is given, an extractor leaves out scopes of the fields it has routes for.
    """
    found = []
    for kind in kinds:
        extractor, pattern = SHAPES[kind]
        hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
        if field:
            own = [f for f, e, _ in V.routes() if e == extractor]
            hits = F.when(F.lower(stripped(split_field(F.coalesce(F.col(field), F.lit("")))[0])).isin(*own), F.array().cast("array<string>")).otherwise(hits)
        found.append(_typed(hits, kind, extractor))
    return scopes.select("*", F.inline(F.flatten(F.array(*found))))


def _typed(hits, kind: str, extractor: str):
    return F.transform(hits, lambda v, i: F.struct(F.lit(kind).alias("entity_type"), F.lit(extractor).alias("extractor"), i.alias("n"), v.alias("value")))
