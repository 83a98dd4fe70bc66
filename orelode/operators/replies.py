"""The boundary to a language model: prompts, calls with retries, and replies against a closed schema.

A template is compiled on the driver to one concatenation of columns. Calls run in the workers, with the provider that
the caller gives; tests give one that answers from a list.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
NAME = re.compile(r"[A-Z][A-Z0-9_]*")


def template_faults(body: str, declared: set[str] | None = None) -> list[str]:
    """Marks that aren't names, unbalanced braces, and names that aren't declared or declared ones that aren't used."""
    names = [m.strip() for m in MARK.findall(body)]
    out = list(dict.fromkeys(f"malformed {{{{{m}}}}}" for m in MARK.findall(body) if not NAME.fullmatch(m.strip())))
    if body.count("{{") != body.count("}}"):
        out.append("unbalanced braces")
    if declared is not None:
        out += [f"undeclared {n}" for n in dict.fromkeys(names) if NAME.fullmatch(n) and n not in declared] + [f"unused {n}" for n in sorted(declared) if n not in names]
    return out


def front_matter(text: str) -> tuple[str, str]:
    """A prompt file's header between lines of three hyphens, and its body."""
    if not text.startswith("---\n") or "\n---\n" not in text[4:]:
        return "", text
    head, body = text[4:].split("\n---\n", 1)
    return head, body


def rendered(body: str, variables: dict[str, Column]) -> Column:
    """The body with each mark replaced once; a value's own marks stay. A missing variable is an error."""
    if missing := [n for n in dict.fromkeys(m.strip() for m in MARK.findall(body)) if n not in variables]:
        raise KeyError(f"no value for {', '.join(missing)}")
    parts, at = [], 0
    for m in MARK.finditer(body):
        parts += [F.lit(body[at : m.start()]), F.coalesce(variables[m[1].strip()].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(body[at:]))


def fenced(text: Column, label: str) -> Column:
    """Untrusted text within marks; marks that it holds itself are taken out."""
    return F.concat(F.lit(f"<<{label}>>\n"), F.regexp_replace(text, r"<</?[A-Z_]+>>", ""), F.lit(f"\n<</{label}>>"))


class TransientError(Exception):
    """A failure that may pass."""


def with_retries(call: Callable[[], str], retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """What ``call`` returns, and the attempts it took; waits double, and only transient failures are tried again."""
    attempt = 1
    while True:
        try:
            return call(), attempt
        except TransientError:
            if attempt > retries:
                raise
            sleep(backoff * 2 ** (attempt - 1))
            attempt += 1


def called(prompts: DataFrame, provider: Callable[[], Callable[[str], str]], retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """``prompts`` (request_id, prompt) with ``reply, attempts, error``. ``provider`` makes a client in each task."""

    def run(batches):
        client = provider()
        for batch in batches:
            rows = []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    rows.append((*with_retries(lambda p=prompt: client(p), retries, backoff), None))
                except Exception as error:  # the row carries it
                    rows.append((None, None, f"{type(error).__name__}: {error}"))
            out = batch.select(["request_id", "prompt"])
            for i, (name, kind) in enumerate((("reply", pa.string()), ("attempts", pa.int32()), ("error", pa.string()))):
                out = out.append_column(name, pa.array([r[i] for r in rows], kind))
            yield out

    return prompts.select(F.col("request_id").cast("string"), "prompt").mapInArrow(run, "request_id string, prompt string, reply string, attempts int, error string")


@dataclass(frozen=True)
class Field:
    """A field of a closed schema; every declared one is required."""

    name: str
    kind: str  # string, integer, number, object, objects, strings, map
    enum: tuple[str, ...] = ()
    const: str = ""
    least: float | None = None
    most: float | None = None
    empty: bool = False
    lines: bool = False
    min_items: int = 0
    fields: tuple[Field, ...] = ()


def schema_issues(value, fields: tuple[Field, ...], path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, message) of what a document breaks."""
    if not isinstance(value, dict):
        yield path, "expected an object"
        return
    for f in fields:
        if f.name not in value:
            yield f"{path}.{f.name}", "required field is missing"
        else:
            yield from field_issues(value[f.name], f, f"{path}.{f.name}")
    for name in sorted(set(value) - {f.name for f in fields}):
        yield f"{path}.{name}", "field is not defined by the schema"


def text_issues(value, f: Field, path: str) -> Iterator[tuple[str, str]]:
    if not isinstance(value, str):
        yield path, "expected a string"
        return
    if not f.lines and ("\n" in value or "\r" in value):
        yield path, "string must be a single line"
    if f.const and value != f.const:
        yield path, f"expected {f.const}"
    elif not value.strip() and not f.empty:
        yield path, "string must not be empty"
    elif f.enum and value not in f.enum and not (f.empty and not value):
        yield path, "not one of the allowed values"


def field_issues(value, f: Field, path: str) -> Iterator[tuple[str, str]]:
    if f.kind == "string":
        yield from text_issues(value, f, path)
    elif f.kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, int if f.kind == "integer" else (int, float)):
            yield path, f"expected {'an integer' if f.kind == 'integer' else 'a number'}"
        elif f.least is not None and value < f.least or f.most is not None and value > f.most:
            yield path, "out of range"
    elif f.kind == "object":
        yield from schema_issues(value, f.fields, path)
    elif f.kind == "map":
        if not isinstance(value, dict):
            yield path, "expected an object"
        else:
            for k in sorted(value):
                yield from text_issues(value[k], Field(k, "string", empty=True), f"{path}.{k}")
    elif not isinstance(value, list):
        yield path, "expected an array"
    else:
        if len(value) < f.min_items:
            yield path, f"expected at least {f.min_items} item(s)"
        for i, item in enumerate(value):
            yield from schema_issues(item, f.fields, f"{path}[{i}]") if f.kind == "objects" else text_issues(item, Field(f.name, "string", enum=f.enum), f"{path}[{i}]")


def reply_issues(replies: DataFrame, fields: tuple[Field, ...], text: str = "reply") -> DataFrame:
    """``request_id, path, message`` of replies; one that isn't a JSON object has one issue."""

    def run(batches):
        for batch in batches:
            rows = []
            for ident, raw in zip(batch.column("request_id").to_pylist(), batch.column("reply").to_pylist(), strict=True):
                try:
                    made = json.loads(raw or "")
                except ValueError:
                    rows.append((ident, "$", "not valid JSON"))
                    continue
                rows += [(ident, p, m) for p, m in schema_issues(made, fields)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["request_id", "path", "message"])

    return replies.select(F.col("request_id").cast("string"), F.col(text).alias("reply")).mapInArrow(run, "request_id string, path string, message string")


def json_schema(fields: tuple[Field, ...]) -> dict:
    """The schema as a JSON-schema document."""
    def one(f: Field) -> dict:
        base = {"string": {"type": "string"}, "integer": {"type": "integer"}, "number": {"type": "number"}, "map": {"type": "object", "additionalProperties": {"type": "string"}}, "strings": {"type": "array", "items": {"type": "string"}}}.get(f.kind)
        out = base or (json_schema(f.fields) if f.kind == "object" else {"type": "array", "items": json_schema(f.fields)})
        limits = {"enum": list(f.enum) or None, "const": f.const or None, "minimum": f.least, "maximum": f.most, "minItems": f.min_items or None}
        return out | {k: v for k, v in limits.items() if v is not None}

    return {"type": "object", "additionalProperties": False, "required": [f.name for f in fields], "properties": {f.name: one(f) for f in fields}}
