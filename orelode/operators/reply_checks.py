"""Checks of typed replies against what was supplied: six groups, all of them run, as arrays of issues within a row.

Replies have ``request_id, operation, result`` (see ``reply_specs.typed``). What was supplied is one row for a request
(``supplied``): its text as it is and folded, its items, its uncertain identifiers and the rule's query. A check reads
one row, so a batch of replies needs one join, for all groups.

Joins are by sorting: what was supplied and what was found repeat themselves, so a table of them is far larger than its
files, and Spark, which goes by these, would send it to all executors through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import one_space, stripped
from orelode.operators import checks as K
from orelode.operators import context as C
from orelode.operators import reply_specs as S
from orelode.operators.replies import Field

GROUPS = ("structure", "evidence", "uncertainty", "rule", "security", "provenance")
ISSUE = "array<struct<code:string,severity:string,path:string,message:string>>"
LEDGER = "array<struct<identifier:string,status:string,candidates:array<string>>>"
#: Shapes of identifiers that prose can assert, and of links: fixed values.
ASSERTED = r"\b(?:TA\d{4}|T\d{4}(?:\.\d{3})?|M\d{4}|S\d{4}|G\d{4}|DS\d{4}|CVE-\d{4}-\d{4,7})\b"
URL = r"https?://[^\s\"'<>)\]]+"
TEMPLATE, FENCE = r"\{\{.*?\}\}", r"<</?[A-Z_]+>>"
#: Codes of the first validator, which goes before the six groups.
REASONING = ("operation_mismatch", "duplicate", "unknown_reference", "unknown_item", "fabricated_identifier", "uncertainty_dropped", "uncertainty_changed", "ambiguity_narrowed", "fabricated_candidate", "fabricated_uncertainty", "presented_as_fact", "unsettled_in_rule", "no_changes", "original_altered", "rule_unchanged", "no_rationale")


def supplied(items: DataFrame, rules: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """``request_id, material, folded, items, ledger, rule_query`` of packages' items and rules (package_id, raw_text, query).

    ``ledger`` has the first report of each identifier that isn't settled; one that was led to a successor is settled.
    Identifiers that only the packages' accounts (``packages.provenance``) call unresolved or ambiguous come after these.
    """
    seed = F.col("kind") == "seed_resolution"
    about = F.struct("source", "location", F.col("kind").isin("retrieved_text", "retrieved_graph").alias("retrieved"), "status", F.coalesce(F.col("metadata")["identifier"], F.lit("")).alias("identifier"))
    unsure = seed & F.col("status").isin("unresolved", "ambiguous")
    entry = F.struct("place", F.col("metadata")["identifier"].alias("identifier"), "status", F.filter(F.split(F.coalesce(F.col("metadata")["candidates"], F.lit("")), ","), lambda c: c != "").alias("candidates"))
    listed = items.groupBy("package_id").agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat_ws("\n", "text", "item_id", F.coalesce("source_id", F.lit("")), F.coalesce("record_id", F.lit(""))).alias("text")))).alias("texts"),
        F.map_from_entries(F.collect_list(F.struct("item_id", about))).alias("items"), F.array_sort(F.collect_list(F.when(unsure, entry))).alias("unsure"),
    )
    first = F.filter("unsure", lambda e, i: F.array_position(F.transform("unsure", lambda x: x["identifier"]), e["identifier"]) == i + 1)
    out = rules.select("package_id", "raw_text", "query").join(listed, "package_id", "full_outer")
    material = F.concat_ws("\n", "raw_text", "query", F.array_join(F.transform("texts", lambda t: t["text"]), "\n"))
    entries = F.coalesce(F.transform(first, lambda e: F.struct(e["identifier"].alias("identifier"), e["status"].alias("status"), e["candidates"].alias("candidates"))), F.array().cast(LEDGER))
    if accounts is not None:
        out = out.withColumn("entries", entries).join(accounts.select("package_id", "unresolved_identifiers", "ambiguous_identifiers").hint("merge"), "package_id", "left")
        listed = lambda status: F.transform(F.array_distinct(F.coalesce(f"{status}_identifiers", F.array().cast("array<string>"))), lambda i: F.struct(i.alias("identifier"), F.lit(status).alias("status"), F.array().cast("array<string>").alias("candidates")))
        more = F.filter(F.concat(listed("unresolved"), listed("ambiguous")), lambda e: ~F.exists("entries", lambda o: o["identifier"] == e["identifier"]))
        entries = F.concat("entries", more.cast(LEDGER))
    return out.select(F.col("package_id").alias("request_id"), material.alias("material"), F.lower(one_space(material)).alias("folded"), F.col("items"), entries.alias("ledger"), F.coalesce("query", F.lit("")).alias("rule_query"))


def at(path: Column | str, i: Column) -> Column:
    return F.concat(path if isinstance(path, Column) else F.lit(path), F.lit("["), i.cast("string"), F.lit("]"))


def below(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def made(code: str, path: Column, message: Column, when: Column, severity: str = "error") -> Column:
    """One issue, or null."""
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message")))


def issues(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts)).cast(ISSUE)


def many(items: Column, each) -> Column:
    """The issues of each item, ``each`` giving an array."""
    return F.coalesce(F.flatten(F.transform(items, each)), F.array().cast(ISSUE)).cast(ISSUE)


def texts(value: Column, fields: tuple[Field, ...], path: Column | None = None) -> Column:
    """(path, value) of all strings of a typed document, as its schema says where they are."""
    def pair(p: Column, x: Column) -> Column:
        return F.struct(p.alias("path"), x.alias("value"))

    def of(f: Field) -> Column | None:
        here, v = F.lit(f.name) if path is None else below(path, f.name), value[f.name]
        if f.kind == "string":
            return F.array(pair(here, v))
        if f.kind == "strings":
            return F.transform(v, lambda x, i: pair(at(here, i), x))
        if f.kind == "map":
            return F.transform(F.map_entries(v), lambda e: pair(F.concat(here, F.lit("."), e["key"]), e["value"]))
        if f.kind == "object":
            return F.when(v.isNotNull(), texts(v, f.fields, here))
        return F.flatten(F.transform(v, lambda o, i: texts(o, f.fields, at(here, i)))) if f.kind == "objects" else None

    none = F.array().cast("array<struct<path:string,value:string>>")
    return F.filter(F.concat(*[F.coalesce(p, none) for p in map(of, fields) if p is not None]), lambda t: t["value"].isNotNull())


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def cited(r: Column) -> Column:
    """All citations with the support that their claim declares."""
    def of(name: str, support: bool) -> Column:
        return F.flatten(F.transform(r[name], lambda o, i: F.transform(o["evidence"], lambda e, j: F.struct(at(below(at(name, i), "evidence"), j).alias("path"), blank(e["item_id"]).alias("item_id"), e["source"].alias("source"), stripped(blank(e["identifier"])).alias("identifier"), (o["support"] if support else F.lit(None).cast("string")).alias("support")))))

    none = F.array().cast("array<struct<path:string,item_id:string,source:string,identifier:string,support:string>>")
    return F.concat(*[F.coalesce(of(n, s), none) for n, s in (("findings", True), ("changes", True), ("mappings", True), ("rationale", False))])


def rules_of(r: Column) -> list[tuple[str, Column]]:
    return [("enhanced_rule", r["enhanced_rule"]), ("generated_rule", r["generated_rule"])]


def in_rule(name: str, rule: Column, one) -> Column:
    return F.transform(rule["mitre"], lambda m, i: one(m, at(f"{name}.mitre", i), F.lit(None).cast("string"), True))


def mapped(r: Column) -> Column:
    """All technique mappings: claims by themselves, and those in a rule (``in_rule``)."""
    names = [f.name for f in S.MITRE]
    one = lambda m, path, support, in_rule: F.struct(path.alias("path"), *[m[n].alias(n) for n in names], support.alias("support"), F.lit(in_rule).alias("in_rule"))
    parts = [F.transform(r["mappings"], lambda m, i: one(m, at("mappings", i), m["support"], False))]
    parts += [in_rule(name, rule, one) for name, rule in rules_of(r)]
    none = F.array().cast("array<struct<path:string," + ",".join(f"{f.name}:{'double' if f.kind == 'number' else 'string'}" for f in S.MITRE) + ",support:string,in_rule:boolean>>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def bounded(path: Column, value: Column, low: float, high: float) -> Column:
    return made("out_of_range", path, F.format_string(f"%s is not in {low:g} to {high:g}", value.cast("string")), value.isNotNull() & (F.isnan(value.cast("double")) | ~value.between(low, high)))


def structure(r: Column, operation: Column, said: Column) -> Column:
    """Operation, fields, numbers, texts, repeated ids, references and impossible combinations."""
    parts = [issues(made("operation_mismatch", F.lit("operation"), F.format_string("it answers %s, asked was %s", r["operation"], operation), ~r["operation"].eqNullSafe(operation)))]
    for name, spec in S.SPECS.items():
        own = {f.name for f in spec}
        parts.append(F.when(operation == name, issues(*[made("missing_value", F.lit(n), F.lit("the schema has this field, the result lacks it"), r[n].isNull()) for n in sorted(own)], *[made("undeclared_field", F.lit(f.name), F.lit("the schema doesn't have this field"), r[f.name].isNotNull()) for f in S.ALL if f.name not in own])))
    parts.append(issues(bounded(F.lit("confidence"), r["confidence"], 0, 1), bounded(F.lit("score"), r["score"], 0, 100), *[bounded(F.lit(f"{n}.risk_score"), rule["risk_score"], 0, 100) for n, rule in rules_of(r)]))
    parts.append(many(r["findings"], lambda f, i: issues(bounded(below(at("findings", i), "confidence"), f["confidence"], 0, 1), made("impossible_combination", below(at("findings", i), "confidence"), F.lit("unsupported, yet sure of it"), (f["support"] == "unsupported") & (f["confidence"] > 0.5)))))
    parts.append(many(mapped(r), lambda m: issues(bounded(below(m["path"], "confidence"), m["confidence"], 0, 1))))
    empty = lambda path, v: made("missing_value", path, F.lit("a required value is empty"), stripped(blank(v)) == "")
    parts.append(issues(empty(F.lit("summary"), r["summary"])))
    wanted = {"findings": ("finding_id", "statement", "explanation"), "recommendations": ("recommendation_id", "action"), "uncertainties": ("identifier", "treatment"), "evasion_risks": ("technique", "description", "mitigation")}

    def filled(name: str, columns: tuple[str, ...]) -> Column:
        return many(r[name], lambda o, i: issues(*[empty(below(at(name, i), c), o[c]) for c in columns]))

    def all_filled(name: str, values: Column) -> Column:
        return many(values, lambda v, i: issues(empty(at(name, i), v)))

    parts += [filled(name, columns) for name, columns in wanted.items()] + [all_filled(n, r[n]) for n in ("strengths", "weaknesses")]
    for name, rule in rules_of(r):
        parts.append(F.when(rule.isNotNull(), F.concat(issues(*[empty(F.lit(f"{name}.{c}"), rule[c]) for c in ("title", "query", "investigation_guide")]), all_filled(f"{name}.tags", rule["tags"]))))
    parts.append(many(said, lambda t: issues(made("several_lines", t["path"], F.lit("one line is allowed"), ~t["path"].endswith(".code_snippet") & t["value"].rlike(r"[\r\n]")))))

    def repeated(name: str, key: str) -> Column:
        ids = F.transform(r[name], lambda o: o[key])
        twice = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)))
        return many(twice, lambda x: issues(made("duplicate", F.lit(name), F.format_string("%s is there more than once", x), F.lit(True))))

    known = F.coalesce(F.transform(r["findings"], lambda f: f["finding_id"]), F.array().cast("array<string>"))

    def references(name: str) -> Column:
        return many(r[name], lambda o, i: many(o["addresses"], lambda x, j: issues(made("unknown_reference", at(below(at(name, i), "addresses"), j), F.format_string("%s is no finding of this result", x), ~F.array_contains(known, x)))))

    parts += [repeated(*x) for x in (("findings", "finding_id"), ("recommendations", "recommendation_id"), ("uncertainties", "identifier"), ("changes", "change_id"))]
    parts += [references(n) for n in ("recommendations", "changes")]
    parts.append(many(r["uncertainties"], lambda u, i: issues(made("impossible_combination", below(at("uncertainties", i), "candidates"), F.lit("unresolved, yet with candidates"), (u["status"] == "unresolved") & (F.size(u["candidates"]) > 0)), made("impossible_combination", below(at("uncertainties", i), "candidates"), F.lit("ambiguous, yet without candidates"), (u["status"] == "ambiguous") & (F.size(u["candidates"]) == 0)))))
    return joined(parts)


def joined(parts: list[Column]) -> Column:
    return F.concat(*[F.coalesce(p, F.array().cast(ISSUE)) for p in parts])


def evidence(r: Column, said: Column) -> Column:
    """Citations, identifiers and names that weren't supplied, and support without a citation."""
    lacks = lambda ident: (ident != "") & ~K.occurs(ident, F.col("material"))
    fabricated = lambda path, ident: made("fabricated_identifier", path, F.format_string("%s isn't in what was supplied", ident), lacks(ident))
    parts = [many(cited(r), lambda c: issues(made("empty_citation", below(c["path"], "item_id"), F.lit("no item is named"), stripped(c["item_id"]) == ""), made("unknown_item", below(c["path"], "item_id"), F.format_string("%s is no supplied item", c["item_id"]), (stripped(c["item_id"]) != "") & ~known_item(c["item_id"])), fabricated(below(c["path"], "identifier"), c["identifier"])))]
    parts.append(many(F.filter(mapped(r), lambda m: ~m["in_rule"]), lambda m: issues(*[fabricated(below(m["path"], n), stripped(blank(m[n]))) for n in ("technique_id", "tactic_id", "parent_technique_id")])))
    unnamed = lambda m, n: made("fabricated_name", below(m["path"], n), F.format_string("%s isn't in what was supplied", stripped(blank(m[n]))), (stripped(blank(m[n])) != "") & ~F.col("folded").contains(F.lower(one_space(blank(m[n])))))
    parts.append(many(mapped(r), lambda m: issues(*[unnamed(m, n) for n in ("tactic_name", "technique_name", "parent_technique_name")])))
    asserted = lambda t: F.array_distinct(F.regexp_extract_all(t["value"], F.lit(ASSERTED), F.lit(0)))
    prose = F.filter(said, lambda t: ~t["path"].rlike(r"(identifier|_id)$"))  # what a field claims is checked above
    parts.append(many(prose, lambda t: many(asserted(t), lambda x: issues(made("fabricated_identifier", t["path"], F.format_string("%s is asserted, but isn't in what was supplied", x), lacks(x))))))

    def bare(name: str) -> Column:
        return many(r[name], lambda o, i: issues(made("unsupported_claim", below(at(name, i), "evidence"), F.lit("called supported, yet nothing is cited"), (o["support"] == "supported") & (F.coalesce(F.size(o["evidence"]), F.lit(0)) <= 0))))

    return joined([*parts, *[bare(n) for n in ("findings", "changes", "mappings")]])


def known_item(ident: Column) -> Column:
    return F.coalesce(F.map_contains_key(F.col("items"), ident), F.lit(False))


def unsettled(ident: Column) -> Column:
    """The status of an identifier that isn't settled, or null."""
    return F.get(F.transform(F.filter(F.col("ledger"), lambda e: e["identifier"] == ident), lambda e: e["status"]), F.lit(0))


def uncertainty(r: Column) -> Column:
    """Identifiers that aren't settled must come back as they were, and no claim may rest on one as if it were."""
    told = F.coalesce(r["uncertainties"], F.array().cast("array<struct<identifier:string,status:string,candidates:array<string>,treatment:string>>"))

    def one(e: Column) -> Column:
        own = F.get(F.filter(F.transform(told, lambda u, i: F.struct(i.alias("i"), u.alias("u"))), lambda x: x["u"]["identifier"] == e["identifier"]), F.lit(0))
        path = lambda n: below(at("uncertainties", own["i"]), n)
        has, had = F.coalesce(own["u"]["candidates"], F.array().cast("array<string>")), e["candidates"]
        missing, more = F.array_except(had, has), F.array_except(has, had)
        there = own.isNotNull()
        return issues(
            made("uncertainty_dropped", F.lit("uncertainties"), F.format_string("%s is %s, but isn't reported", e["identifier"], e["status"]), ~there), made("uncertainty_changed", path("status"), F.format_string("%s is %s, reported as %s", e["identifier"], e["status"], own["u"]["status"]), there & (own["u"]["status"] != e["status"])),
            made("ambiguity_narrowed", path("candidates"), F.format_string("%s lacks %s", e["identifier"], F.array_join(missing, ", ")), there & (F.size(missing) > 0)), made("fabricated_candidate", path("candidates"), F.format_string("%s has %s besides", e["identifier"], F.array_join(more, ", ")), there & (F.size(more) > 0)),
        )

    parts = [many(F.col("ledger"), one)]
    parts.append(many(told, lambda u, i: issues(made("fabricated_uncertainty", below(at("uncertainties", i), "identifier"), F.format_string("%s is settled", u["identifier"]), unsettled(u["identifier"]).isNull()))))
    fact = lambda path, ident, support: made("presented_as_fact", path, F.format_string("it rests on %s, which is %s, yet is called supported", ident, unsettled(ident)), (support == "supported") & unsettled(ident).isNotNull())
    parts.append(many(cited(r), lambda c: issues(fact(c["path"], c["identifier"], c["support"]))))
    ids = ("technique_id", "tactic_id")
    parts.append(many(mapped(r), lambda m: issues(*[fact(below(m["path"], n), stripped(blank(m[n])), m["support"]) for n in (*ids, "parent_technique_id")], *[made("unsettled_in_rule", below(m["path"], n), F.format_string("the rule names %s, which is %s", m[n], unsettled(stripped(blank(m[n])))), m["in_rule"] & unsettled(stripped(blank(m[n]))).isNotNull()) for n in ids])))
    return joined(parts)


def rule(r: Column, operation: Column) -> Column:
    """A rule that is made can be loaded, names what was supplied, and differs from its original as it says."""
    parts = []
    for name, own in rules_of(r):
        ok, band = F.lit(False), F.lit(False)
        for kind, languages in K.LANGUAGES.items():
            ok = ok | ((own["rule_type"] == kind) & own["language"].isin(*languages))
        for severity, (low, high) in K.RISK.items():
            band = band | ((own["severity"] == severity) & ~own["risk_score"].between(low, high))
        path = lambda c, name=name: F.lit(f"{name}.{c}")
        parts.append(F.when(own.isNotNull(), issues(
            made("language_mismatch", path("language"), F.concat_ws("/", own["rule_type"], own["language"]), ~ok), made("incomplete_rule", path("query"), F.lit("no query"), stripped(blank(own["query"])) == ""), made("incomplete_rule", path("investigation_guide"), F.lit("no guide"), stripped(blank(own["investigation_guide"])) == ""),
            made("risk_outside_band", path("risk_score"), F.concat_ws("/", own["severity"], own["risk_score"].cast("string")), band, "warning"),
        )))
    missing = lambda m, n: made("fabricated_mapping", below(m["path"], n), F.format_string("%s isn't in what was supplied", m[n]), (stripped(blank(m[n])) != "") & ~K.occurs(stripped(blank(m[n])), F.col("material")))
    parts.append(many(F.filter(mapped(r), lambda m: m["in_rule"]), lambda m: issues(*[missing(m, n) for n in ("technique_id", "tactic_id", "parent_technique_id")])))
    stated, given, new = (K.unpadded(blank(c)) for c in (r["original_rule"]["query"], F.col("rule_query"), r["enhanced_rule"]["query"]))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    parts.append(F.when(operation == "enhance", issues(made("no_changes", F.lit("changes"), F.lit("no change is accounted for"), none(r["changes"])), made("original_altered", F.lit("original_rule.query"), F.lit("it isn't the supplied query"), (given != "") & (stated != "") & (given != stated)), made("rule_unchanged", F.lit("enhanced_rule.query"), F.lit("it is the original query"), (stated != "") & (stated == new)))))
    parts.append(F.when(operation == "generate", issues(made("no_rationale", F.lit("rationale"), F.lit("no decision is accounted for"), none(r["rationale"])))))
    return joined(parts)


def security(said: Column) -> Column:
    """What a result must not carry out: credentials, template marks, fences, and links that nobody supplied."""
    secret = lambda v: F.array_join(F.array_compact(F.array(*[F.when(v.rlike(p), n) for n, p, _ in C.CREDENTIALS])), ", ")
    links = lambda v: F.filter(F.regexp_extract_all(v, F.lit(URL), F.lit(0)), lambda u: ~F.col("material").contains(u))
    return joined([many(said, lambda t: F.concat(issues(made("credential", t["path"], secret(t["value"]), secret(t["value"]) != ""), made("template_mark", t["path"], F.lit("a placeholder of the prompt"), t["value"].rlike(TEMPLATE)), made("fence_mark", t["path"], F.lit("a fence of the prompt"), t["value"].rlike(FENCE))), many(links(t["value"]), lambda u: issues(made("fabricated_reference", t["path"], F.format_string("%s wasn't supplied", u), F.lit(True))))))])


def provenance(r: Column) -> Column:
    """Citations of supplied items: their source, a place to trace them to, and identifiers that stay unsettled."""
    told = F.coalesce(F.transform(r["uncertainties"], lambda u: u["identifier"]), F.array().cast("array<string>"))

    def one(c: Column) -> Column:
        item = F.col("items")[c["item_id"]]
        return F.when(known_item(c["item_id"]), issues(
            made("source_mismatch", below(c["path"], "source"), F.format_string("%s came from %s", c["item_id"], item["source"]), item["source"].isNotNull() & ~c["source"].eqNullSafe(item["source"])), made("not_traceable", below(c["path"], "item_id"), F.format_string("%s has no place", c["item_id"]), item["retrieved"] & (blank(item["location"]) == "")),
            made("status_not_preserved", below(c["path"], "item_id"), F.format_string("%s is %s, but isn't reported", item["identifier"], item["status"]), item["status"].isin("unresolved", "ambiguous") & (blank(item["identifier"]) != "") & ~F.array_contains(told, item["identifier"])),
        ))

    return joined([many(cited(r), lambda c: F.coalesce(one(c), F.array().cast(ISSUE)))])


def checked(replies: DataFrame, given: DataFrame) -> DataFrame:
    """``request_id, category, code, severity, path, message`` of all issues; a reply without a result has one."""
    none = F.array().cast(ISSUE)
    rows = replies.select("request_id", "operation", "result").join(given.hint("merge"), "request_id", "left")
    rows = rows.withColumns({"material": blank(F.col("material")), "folded": blank(F.col("folded")), "rule_query": blank(F.col("rule_query")), "ledger": F.coalesce("ledger", F.array().cast("array<struct<identifier:string,status:string,candidates:array<string>>>"))})
    r, op = F.col("result"), F.col("operation")
    rows = rows.withColumn("said", texts(r, S.ALL))
    said = F.col("said")
    groups = {"structure": structure(r, op, said), "evidence": evidence(r, said), "uncertainty": uncertainty(r), "rule": rule(r, op), "security": security(said), "provenance": provenance(r)}
    broken = F.array(F.struct(F.lit("no_result").alias("code"), F.lit("error").alias("severity"), F.lit("$").alias("path"), F.lit("the reply has no result").alias("message"))).cast(ISSUE)

    def tag(group: str, found: Column) -> Column:
        own = F.when(r.isNull(), broken if group == "structure" else none).otherwise(found)
        return F.transform(own, lambda i: F.struct(F.lit(group).alias("category"), i["code"].alias("code"), i["severity"].alias("severity"), i["path"].alias("path"), i["message"].alias("message")))

    return rows.select("request_id", F.inline(F.concat(*[tag(g, c) for g, c in groups.items()])))


def verdicts(replies: DataFrame, found: DataFrame) -> DataFrame:
    """Every reply with its errors, warnings, whether it is valid (without an error), and its issues by category, path, code and message."""
    per = found.groupBy("request_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_sort(F.collect_list(F.struct("category", "path", "code", "message"))).alias("issues"))
    out = replies.select("request_id").join(per.hint("merge"), "request_id", "left")
    return out.select("request_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("valid"), F.coalesce("issues", F.array().cast("array<struct<category:string,path:string,code:string,message:string>>")).alias("issues"))


def reasoning_issues(found: DataFrame) -> DataFrame:
    """The issues of the first validator: those of shape, supply and uncertainty that make a result no answer."""
    return found.filter(F.col("code").isin(*REASONING))
