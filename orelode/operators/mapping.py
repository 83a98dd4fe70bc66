"""Canonical forms of entities: one row in, one row out.

All kinds are branches of one CASE over (entity_type, value, source_field), in code the JVM compiles. Only addresses
that aren't plain IPv4 go to Python's ipaddress, as a frame of their own.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import stripped
from orelode.operators import vocabulary as V
from orelode.session import arrow_task

OUT = "struct<canonical_type:string,canonical_value:string,canonical_id:string,status:string,method:string,note:string>"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
IPV4_NET = rf"^{OCTET}(?:\.{OCTET}){{3}}/(?:3[0-2]|[12]?[0-9])$"
PLAIN = {
    "process": "process", "executable": "process_image", "service": "service", "scheduled_task": "scheduled_task", "command_line": "command_line", "command_argument": "command_argument",
    "file_path": "file_path", "file_name": "file_name", "directory": "directory", "registry_value": "registry_value_name", "registry_data": "registry_value_data",
    "windows_event_channel": "event_channel", "windows_event_provider": "event_provider", "linux_event": "linux_audit_event", "url": "url", "author": "author", "log_index": "log_index", "timeframe": "timeframe", "field_modifier": "field_modifier",
}
LOWERED = {"network_protocol": "network_protocol", "dns_name": "domain_name", "product": "log_product", "category": "log_category", "log_source_service": "log_service"}
TAGS = (("attack_technique_reference", r"(?i)^T[0-9]{4}(?:\.[0-9]{3})?\z"), ("attack_tactic_reference", r"(?i)^TA[0-9]{4}\z"), ("attack_group_reference", r"(?i)^G[0-9]{4}\z"), ("attack_software_reference", r"(?i)^S[0-9]{4}\z"), ("cve_reference", r"(?i)^CVE-[0-9]{4}-[0-9]{4,}\z"))


def outcome(kind, value, ident, status: str, method: str, note: str | None = None) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(kind).alias("canonical_type"), col(value).cast("string").alias("canonical_value"), col(ident).cast("string").alias("canonical_id"), col(status).alias("status"), col(method).alias("method"), col(note).cast("string").alias("note")).cast(OUT)


def exact(kind, ident=None, method: str = "direct_type") -> Column:
    return outcome(kind, F.col("value"), ident, "exact", method)


def normalized(kind, value, method: str, ident=None) -> Column:
    return outcome(kind, value, ident, "normalized", method)


def unresolved(kind, note: str, method: str = "syntax_pattern") -> Column:
    return outcome(kind, None, None, "unresolved", method, note)


def exact_or(kind, canonical: Column, method: str, ident: Column | None = None) -> Column:
    return F.when(canonical == F.col("value"), exact(kind, ident)).otherwise(normalized(kind, canonical, method, ident))


def file_hash() -> Column:
    v = F.col("value")
    labelled, bare = r"^\s*([A-Za-z0-9_]+)\s*=\s*([A-Fa-f0-9]+)\s*$", r"^\s*([A-Fa-f0-9]+)\s*$"
    digest = F.lower(F.regexp_extract(v, bare, 1))
    return (
        F.when((F.length(v) - F.length(F.replace(v, F.lit("="), F.lit(""))) > 1) | v.contains(","), unresolved("file_hash", "several digests, so none is taken", "ambiguous"))
        .when(v.rlike(labelled), normalized("file_hash", F.lower(F.regexp_extract(v, labelled, 2)), "value_split"))
        .when(v.rlike(bare) & F.length(digest).isin(32, 40, 64), normalized("file_hash", digest, "syntax_pattern"))
        .when(v.rlike(bare), unresolved("file_hash", "no algorithm has digests of this length"))
        .otherwise(unresolved("file_hash", "not a hash digest"))
    )


def registry_key() -> Column:
    v, head = F.col("value"), F.substring_index("value", "\\", 1)
    hive = F.lit(None).cast("string")
    for short, name in V.HIVES.items():
        hive = F.when(F.lower(stripped(head)).isin(short, name.lower()), name).otherwise(hive)
    tail = F.substring(v, F.length(head) + 2, F.length(v))
    return (
        F.when(~v.contains("\\"), unresolved("registry_key", "no hive before the first backslash"))
        .when(hive.isNull(), unresolved("registry_key", "not the name of a hive"))
        .when(hive == head, exact("registry_key"))
        .otherwise(normalized("registry_key", F.concat(hive, F.lit("\\"), tail), "alias_table"))
    )


#: What branches share, each computed once: of a value, its trimmed and lower form, a tag's token, a field's base name, and an address as numbers.
def shared(entities: DataFrame) -> DataFrame:
    v = stripped("value")
    name = F.coalesce(F.when(F.col("source_field") != "", F.col("source_field")), F.col("value"))
    rows = entities.withColumns({"m_trim": v, "m_base": split_field(name)[0], "m_token": F.when(F.lower(v).startswith("attack."), F.substring(v, 8, F.length(v))).otherwise(v), "m_parts": F.split(F.substring_index(v, "/", 1), r"\."), "m_prefix": F.substring_index(v, "/", -1).try_cast("int")})
    number = sum((F.get("m_parts", F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - F.col("m_prefix"))
    rows = rows.withColumns({"m_low": F.lower("m_trim"), "m_up": F.upper("m_token"), "m_base": F.when(F.col("m_base") == "", F.col("value")).otherwise(F.col("m_base")), "m_net": F.when((F.col("entity_type") == "ip_address") & F.col("m_trim").rlike(IPV4_NET), number - number % size)})
    return rows.withColumn("m_key", F.lower(stripped("m_base")))


def ipv4() -> Column:
    """A plain address, or the network that a prefix length leaves of it."""
    v, base = F.col("m_trim"), F.col("m_net")
    net = F.concat_ws(".", *[(F.floor(base / 256 ** (3 - i)) % 256).cast("string") for i in range(4)])
    whole = F.concat(net, F.lit("/"), F.col("m_prefix").cast("string"))
    return F.when(v.rlike(IPV4), exact("ip_address", v)).otherwise(normalized("ip_network", whole, "syntax_pattern", whole))


def tag() -> Column:
    token, up = F.col("m_token"), F.col("m_up")
    attack = F.col("m_low").startswith("attack.")
    out = F.when(attack & (token != ""), normalized("attack_tactic_reference", F.lower(token), "syntax_pattern")).otherwise(exact("rule_tag"))
    for kind, pattern in reversed(TAGS):
        out = F.when(token.rlike(pattern), exact_or(kind, up, "syntax_pattern", up)).otherwise(out)
    return out


def vocabulary(kind: str, allowed: tuple[str, ...]) -> Column:
    token = F.col("m_low")
    return F.when(~token.isin(*allowed), unresolved(kind, f"not a known {kind}", "enum_conversion")).otherwise(exact_or(kind, token, "enum_conversion", token))


def split_field(name: Column) -> tuple[Column, Column]:
    """A field's name to look up, and its modifiers: what follows a bar, and a last ``.caseless``."""
    parts = F.split(name, r"\|")
    head, tail = F.element_at(parts, 1), F.filter(F.slice(parts, 2, 1000), lambda x: x != "")
    cut = head.rlike(r"(?i)^.+\.caseless$")
    return F.when(cut, F.regexp_replace(head, r"(?i)\.caseless$", "")).otherwise(head), F.when(cut, F.concat(tail, F.array(F.element_at(F.split(head, r"\."), -1)))).otherwise(tail)


def field() -> Column:
    base, key = F.col("m_base"), F.col("m_key")
    of: dict[str, list[str]] = {}
    for f, c in V.categories():
        of.setdefault(f, []).append(c)
    single = F.lit(None).cast("string")
    for c, names in V.FIELD_CATEGORIES.items():
        if some := [f for f in names if len(of[f]) == 1]:
            single = F.when(key.isin(*some), c).otherwise(single)
    several = key.isin(*[f for f, c in of.items() if len(c) > 1])
    return F.when(several, unresolved("unknown_field", "a field of several categories", "ambiguous")).when(single.isNull(), unresolved("unknown_field", "not a known field", "alias_table")).otherwise(outcome(single, base, None, "alias", "alias_table"))


def branches() -> dict[str, Column]:
    v, trimmed, low = F.col("value"), F.col("m_trim"), F.col("m_low")
    out = {t: exact(c) for t, c in PLAIN.items()}
    out |= {t: F.when(trimmed == "", unresolved(c, "nothing is stated", "none")).otherwise(exact_or(c, low, "case_normalization")) for t, c in LOWERED.items()}
    number = r"^\d+$"
    out["file_hash"], out["registry_key"], out["tag"], out["field"] = file_hash(), registry_key(), tag(), field()
    out["windows_event_id"] = F.when(trimmed.rlike(number), exact("event_id", trimmed)).otherwise(unresolved("event_id", "not an event number"))
    out["network_port"] = F.when(trimmed.rlike(number) & (F.coalesce(trimmed.try_cast("long"), F.lit(99999)) <= 65535), exact("network_port", trimmed)).otherwise(unresolved("network_port", "not a port from 0 to 65535"))
    out["reference"] = F.when(trimmed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$"), exact("reference_url")).otherwise(unresolved("unknown", "not a URL"))
    out["severity"], out["status"] = vocabulary("severity_level", V.SEVERITIES), vocabulary("rule_status", V.STATUSES)
    empty = unresolved("unknown", "nothing is stated", "none")
    out["group"] = F.when(trimmed == "", empty).otherwise(exact("group"))
    out["user"] = F.when(trimmed == "", empty).when(trimmed.rlike(r"(?i)^S-\d+-\d+(?:-\d+)*$"), exact_or("security_identifier", F.upper(trimmed), "case_normalization", F.upper(trimmed))).otherwise(F.when(v.isNotNull(), exact("user_account")))
    out["ip_address"] = ipv4()
    return out


def address_batches(batches):
    for batch in batches:
        rows = []
        for value in batch.column("value").to_pylist():
            v = (value or "").strip()
            try:
                rows.append(("ip_address", value, str(ipaddress.ip_address(v)), "exact", "direct_type", None))
            except ValueError:
                try:
                    net = str(ipaddress.ip_network(v, strict=False))
                    rows.append(("ip_network", net, net, "normalized", "syntax_pattern", None))
                except ValueError:
                    rows.append(("ip_address", None, None, "unresolved", "syntax_pattern", "not an address or a network"))
        names = ("canonical_type", "canonical_value", "canonical_id", "status", "method", "note")
        made = pa.array([dict(zip(names, r, strict=True)) for r in rows], pa.struct([(n, pa.string()) for n in names]))
        yield batch.append_column("mapped", made)


def mapped(entities: DataFrame) -> DataFrame:
    """``entities`` (entity_type, value, source_field and more) with the struct ``mapped``; unknown types are unresolved."""
    out = unresolved("unknown", "a type without a canonical form", "none")
    for kind, branch in branches().items():
        out = F.when(F.col("entity_type") == kind, branch).otherwise(out)
    odd = (F.col("entity_type") == "ip_address") & ~F.coalesce(stripped("value").rlike(IPV4) | stripped("value").rlike(IPV4_NET), F.lit(False))
    native = shared(entities.filter(~F.coalesce(odd, F.lit(False)))).select(*entities.columns, out.alias("mapped"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entities.schema.fields)
    return native.unionByName(entities.filter(odd).mapInArrow(arrow_task(__name__, "address_batches"), f"{schema}, mapped {OUT}"))


def detailed(rows: DataFrame) -> DataFrame:
    """Mapped entities with ``confidence`` (1.0 for what has a canonical form, else 0.0) and ``attributes``.

    Attributes are a digest's algorithm, an address's version, a network's prefix, a tactic's slug, the hive of a key,
    the field that a name without a category still names, and the event's number.
    """
    m, v = F.col("mapped"), stripped("value")
    kind, done = m["canonical_type"], m["status"] != "unresolved"
    labelled = F.regexp_extract("value", r"^\s*([A-Za-z0-9_]+)\s*=", 1)
    size = F.length(m["canonical_value"])
    algorithm = F.when(labelled != "", F.lower(labelled)).when(size == 32, "md5").when(size == 40, "sha1").when(size == 64, "sha256")
    address = kind.isin("ip_address", "ip_network") & done
    made = {
        "algorithm": F.when((kind == "file_hash") & done, algorithm),
        "version": F.when(address, F.when(m["canonical_id"].contains(":"), "6").otherwise("4")),
        "prefix_length": F.when((kind == "ip_network") & done, F.substring_index(m["canonical_id"], "/", -1)),
        "tactic": F.when((kind == "attack_tactic_reference") & m["canonical_id"].isNull() & done, m["canonical_value"]),
        "hive": F.when((kind == "registry_key") & done, F.substring_index(m["canonical_value"], "\\", 1)),
        "canonical_field": F.when(F.col("entity_type") == "field", split_field(F.coalesce(F.when(F.col("source_field") != "", F.col("source_field")), F.col("value")))[0]),
        "event_id": F.when((kind == "event_id") & done, v),
    }
    attributes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values())), lambda _, x: x.isNotNull())
    return rows.withColumns({"confidence": F.when(done, 1.0).otherwise(0.0), "attributes": attributes})


def unambiguous(rows: DataFrame) -> DataFrame:
    """Mapped entities; one with several readings is an error."""
    bad = F.raise_error(F.format_string("%s '%s' has several readings", "entity_type", "value")).cast("boolean")
    return rows.filter(F.when(F.coalesce(F.col("mapped.method") != "ambiguous", F.lit(True)), True).otherwise(bad))


def of_status(rows: DataFrame, *statuses: str) -> DataFrame:
    return rows.filter(F.col("mapped.status").isin(*statuses))


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    return rows.filter(F.col("mapped.canonical_type").isin(*types))


def identifiers_of(rows: DataFrame, canonical_type: str, key: str = "rule_id", order: str = "ordinal") -> DataFrame:
    """``key, identifiers``: the distinct canonical ids of a type in the order they are first seen."""
    some = of_type(rows, canonical_type).filter("mapped.canonical_id IS NOT NULL")
    first = some.groupBy(key, F.col("mapped.canonical_id").alias("i")).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "i"))), lambda x: x["i"]).alias("identifiers"))


def grouped(rows: DataFrame, key: str = "rule_id", order: str = "ordinal") -> DataFrame:
    """``key, canonical_type, n, canonical_values``: how many of each type, and what they are in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("mapped.canonical_value", "value").alias("v"))))
    return rows.groupBy(key, F.col("mapped.canonical_type").alias("canonical_type")).agg(F.count(F.lit(1)).alias("n"), F.transform(listed, lambda x: x["v"]).alias("canonical_values"))


def resolved(rows: DataFrame) -> DataFrame:
    return rows.filter("mapped.status <> 'unresolved'")


def ambiguous(rows: DataFrame) -> DataFrame:
    return rows.filter("mapped.method = 'ambiguous'")
