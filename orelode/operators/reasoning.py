"""From packages to checked documents: prompt variables, prompt assembly, provider calls, and the three entry points.

A provider is a function from a request (a map) to a response (a map with ``text, finish_reason, model, input_tokens,
output_tokens``) that may raise; calls run in the workers. Everything else is relations over a batch of requests.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import replies as L
from orelode.operators import reply_checks as C
from orelode.operators import reply_specs as S
from orelode.session import settled

#: Names of the prompt's variables in their order, and the sources that have one of their own: fixed values.
VARIABLES = ("RULE", "CONTEXT", "ENTITIES", "MITRE", "SIGMA", "ELASTIC", "ATOMIC", "LOLBAS", "SIMILAR_RULES", "OUTPUT_FORMAT")
OWN = {"mitre": "MITRE", "sigma": "SIGMA", "elastic": "ELASTIC", "lolbas": "LOLBAS"}
SIMILAR, RETRIEVED = ("elastic", "sigma"), ("retrieved_text", "retrieved_graph")
NOTHING = "Nothing of this kind was supplied. Don't fill it in from memory."
#: Why providers stop, in their words: fixed values.
FINISH = {"STOP": "stop", "END_TURN": "stop", "COMPLETE": "stop", "MAX_TOKENS": "max_tokens", "LENGTH": "max_tokens", "SAFETY": "safety", "BLOCKLIST": "safety", "PROHIBITED_CONTENT": "safety", "RECITATION": "recitation", "ERROR": "error", "MALFORMED_FUNCTION_CALL": "error"}
REPLIED = "request_id string, reply string, finish_reason string, model string, input_tokens long, output_tokens long, attempts int, error string, error_kind string"


def block(items: Column) -> Column:
    """Items (item_id, text) each under its id, parted by blank lines; a remark if there are none."""
    shown = F.array_join(F.transform(items, lambda i: F.concat(F.lit("["), i["item_id"], F.lit("]\n"), i["text"])), "\n\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, shown).otherwise(NOTHING)


def variables(items: DataFrame, rules: DataFrame, operations: DataFrame) -> DataFrame:
    """``request_id, operation`` and a column for each of ``VARIABLES``.

    Evidence goes to its source's block, all else that was retrieved and the seeds to the context; the rule is untrusted
    and stands in a fence, its own fence marks taken out.
    """
    got = F.col("kind").isin(*RETRIEVED)
    own = F.when(got & F.col("source").isin(*OWN), F.col("source")).when(F.col("section").isin("entities", "mappings"), "entities").when(F.col("section") == "rule", "rule").when(F.col("section") == "metadata", "metadata").otherwise("context")
    rows = items.withColumn("bucket", own).withColumn("item", F.struct("place", "item_id", "text"))
    of = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("item"))))
    buckets = rows.groupBy("package_id").agg(*[of(F.col("bucket") == b).alias(b) for b in (*OWN, "entities", "rule", "context")], of(got & F.col("source").isin(*SIMILAR)).alias("similar"))
    asked = operations.select(F.col("package_id").cast("string"), "operation").join(buckets, "package_id", "left").join(rules.select("package_id", "raw_text"), "package_id", "left")
    stated = F.when(stripped(F.coalesce("raw_text", F.lit(""))) != "", F.col("raw_text")).otherwise(F.array_join(F.transform("rule", lambda i: i["text"]), "\n\n"))
    form = F.lit(None).cast("string")
    for operation, spec in S.SPECS.items():
        form = F.when(F.col("operation") == operation, S.prompt_text(spec) + "\n\n" + json.dumps(S.skeleton(spec), indent=1)).otherwise(form)
    made = {"RULE": F.when(stripped(F.coalesce(stated, F.lit(""))) != "", L.fenced(stated, "RULE")).otherwise(NOTHING), "CONTEXT": block(F.col("context")), "ENTITIES": block(F.col("entities")), "ATOMIC": F.lit(NOTHING), "SIMILAR_RULES": block(F.col("similar")), "OUTPUT_FORMAT": form}
    made |= {name: block(F.col(source)) for source, name in OWN.items()}
    return asked.select(F.col("package_id").alias("request_id"), "operation", *[made[v].alias(v) for v in VARIABLES])


class Prompts:
    """Templates in a folder: ``shared/<name>.md`` and ``<operation>/system.md``, ``<operation>/instruction.md``."""

    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()

    def path(self, scope: str, name: str) -> Path:
        """A template's file; a name that leads out of the folder is an error."""
        found = (self.root / scope / f"{name}.md").resolve()
        if not found.is_relative_to(self.root):
            raise ValueError(f"{scope}/{name} lies outside the prompts")
        if not found.is_file():
            raise FileNotFoundError(f"no prompt {scope}/{name}")
        return found

    def body(self, scope: str, name: str) -> str:
        _, body = L.front_matter(self.path(scope, name).read_text(encoding="utf-8"))
        if faults := [f for f in L.template_faults(body, set(VARIABLES)) if not f.startswith("unused")]:
            raise ValueError(f"{scope}/{name}: {'; '.join(faults)}")
        return body.strip()

    def assembled(self, operation: str, shared: tuple[str, ...] = ()) -> tuple[str, str, tuple[str, ...]]:
        """The system text (shared parts first), the instruction, and the variables that they use, as first seen."""
        system = "\n\n".join([*(self.body("shared", n) for n in shared), self.body(operation, "system")])
        instruction = self.body(operation, "instruction")
        return system, instruction, tuple(dict.fromkeys(m.strip() for m in L.MARK.findall(system + instruction)))


def prompted(asked: DataFrame, prompts: Prompts, shared: tuple[str, ...] = ()) -> DataFrame:
    """``request_id, operation, system, instruction`` of variables: each operation's templates, filled in once."""
    columns = {v: F.col(v) for v in VARIABLES}
    system = instruction = F.lit(None).cast("string")
    for operation in S.OPERATIONS:
        try:
            a, b, _ = prompts.assembled(operation, shared)
        except FileNotFoundError:
            continue  # no request of an operation without prompts can be rendered: it stays null
        system = F.when(F.col("operation") == operation, L.rendered(a, columns)).otherwise(system)
        instruction = F.when(F.col("operation") == operation, L.rendered(b, columns)).otherwise(instruction)
    return asked.select("request_id", "operation", system.alias("system"), instruction.alias("instruction"))


def request_of(system: str, instruction: str, operation: str, settings: dict) -> dict:
    """What a provider is sent: the texts, the reply's schema, and the model's settings."""
    return {"system": system, "prompt": instruction, "schema": S.schema_of(operation), "model": settings.get("model", ""), "temperature": settings.get("temperature", 0.0), "max_output_tokens": settings.get("max_output_tokens", 8192), "timeout_seconds": settings.get("timeout_seconds", 60.0)}


def finish_reason(value: str | None) -> str:
    return FINISH.get((value or "").strip().upper(), "unknown")


def error_kind(error: BaseException) -> str:
    """What kind of failure it is, by its type and status."""
    name = type(error).__name__.lower()
    code = getattr(error, "status_code", getattr(error, "code", None))
    if isinstance(error, TimeoutError) or "timeout" in name:
        return "timeout"
    if isinstance(code, int):
        kind = {401: "authentication", 403: "authentication", 404: "model_unavailable", 429: "rate_limit"}.get(code)
        if kind or 500 <= code < 600:
            return kind or "service_unavailable"
    return "connection" if isinstance(error, ConnectionError) or "connect" in name or "network" in name else "provider"


#: Failures that may pass, and so are tried again.
TRANSIENT = ("timeout", "rate_limit", "service_unavailable", "connection")


def asked_of(prompts: DataFrame, provider: Callable[[], Callable[[dict], dict]], settings: dict | None = None, retries: int = 3, backoff: float = 1.0) -> DataFrame:
    """A row for each prompt with its reply, why the provider stopped, the tokens, the attempts, or the failure and its kind.

    A reply that was cut short or held back is a failure. ``provider`` makes a client in each task.
    """
    own = settings or {}

    def run(batches):
        client = provider()

        def call(row: dict) -> dict:
            try:
                return client(request_of(row["system"], row["instruction"], row["operation"], own))
            except Exception as error:
                if error_kind(error) in TRANSIENT:
                    raise L.TransientError(f"{error_kind(error)}: {error}") from error
                raise

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    got, attempts = L.with_retries(lambda row=row: call(row), retries, backoff)
                    reason = finish_reason(got.get("finish_reason"))
                    bad = reason if reason not in ("stop", "unknown") else None
                    rows.append((row["request_id"], None if bad else got.get("text"), reason, got.get("model", ""), got.get("input_tokens", 0), got.get("output_tokens", 0), attempts, f"the provider stopped: {bad}" if bad else None, bad))
                except L.TransientError as error:
                    rows.append((row["request_id"], None, None, None, 0, 0, retries + 1, str(error), str(error).split(":")[0]))
                except Exception as error:  # the row carries it
                    rows.append((row["request_id"], None, None, None, 0, 0, 1, f"{type(error).__name__}: {error}", error_kind(error)))
            kinds = (*[pa.string()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            names = [c.split(" ")[0] for c in REPLIED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return prompts.select(F.col("request_id").cast("string"), "operation", "system", "instruction").mapInArrow(run, REPLIED)


def usage(replied: DataFrame) -> DataFrame:
    """Tokens by model, and how many requests failed."""
    return replied.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("requests"))


def reasoned(operations: DataFrame, items: DataFrame, rules: DataFrame, prompts: Prompts, provider: Callable[[], Callable[[dict], dict]], shared: tuple[str, ...] = (), settings: dict | None = None, retries: int = 3, backoff: float = 1.0) -> dict[str, DataFrame]:
    """From packages (their items, rules and operations) to replies, their issues, verdicts, and documents of the valid ones.

    Each request is answered once: replies are computed before they are checked.
    """
    replied = settled(asked_of(prompted(variables(items, rules, operations), prompts, shared), provider, settings, retries, backoff))
    asked = operations.select(F.col("package_id").cast("string").alias("request_id"), "operation")
    schema = [settled(L.reply_issues(replied.join(asked.filter(F.col("operation") == op).select("request_id"), "request_id").filter("reply IS NOT NULL"), S.SPECS[op])) for op in S.OPERATIONS]
    broken = schema[0].unionByName(schema[1]).unionByName(schema[2])
    good = replied.join(broken.select("request_id").distinct(), "request_id", "left_anti")
    typed = settled(S.typed(asked.join(good, "request_id", "left")))
    issues = settled(C.checked(typed, settled(C.supplied(items, rules))))
    verdicts = C.verdicts(typed, issues)
    run = typed.join(verdicts.filter("valid").select("request_id"), "request_id", "left_semi").withColumns({"result_id": F.uuid(), "rule_id": F.col("request_id"), "tokens": F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0)), "latency_ms": F.lit(0), "user_id": F.lit(""), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "saved": F.lit(False), "saved_rule_id": F.lit(None).cast("string"), "saved_rule_title": F.lit("")})
    run = run.join(rules.select(F.col("package_id").alias("request_id"), F.col("query").alias("input_query")), "request_id", "left")
    return {"replies": replied, "schema_issues": broken, "issues": issues, "verdicts": verdicts, "documents": S.documents(run)}


def analyze(packages: DataFrame, items: DataFrame, rules: DataFrame, prompts: Prompts, provider, **settings) -> dict[str, DataFrame]:
    """Assessments of the rules of packages (package_id)."""
    return reasoned(packages.select("package_id", F.lit("analyze").alias("operation")), items, rules, prompts, provider, **settings)


def enhance(packages: DataFrame, items: DataFrame, rules: DataFrame, prompts: Prompts, provider, **settings) -> dict[str, DataFrame]:
    """Rewrites of the rules of packages (package_id)."""
    return reasoned(packages.select("package_id", F.lit("enhance").alias("operation")), items, rules, prompts, provider, **settings)


def generate(packages: DataFrame, items: DataFrame, rules: DataFrame, prompts: Prompts, provider, **settings) -> dict[str, DataFrame]:
    """New rules for the requirements of packages (package_id)."""
    return reasoned(packages.select("package_id", F.lit("generate").alias("operation")), items, rules, prompts, provider, **settings)
