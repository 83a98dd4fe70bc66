"""The retrieval benchmark: its cases, relevance by seven rules over records, runs of all modes, and safety findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orelode.functions.text import folded, stripped
from orelode.operators import evaluation as E
from orelode.operators import metrics as M
from orelode.operators import references as R
from orelode.operators import retrieval as Q
from orelode.operators import text_index as X
from orelode.session import settled

RULES = ("attack_technique", "technique_name", "ecs_field", "lolbas_binary", "citing_records_only", "all_candidates", "none_expected")
DEPTH, KS = 120, (1, 3, 5, 10)
#: Case, query, category, rule, anchor, and the identifier and field that the query names: fixed values.
CASES = (
    ("attack-001", "T1059.001", "exact_attack_id", "attack_technique", "T1059.001", "T1059.001", ""),
    ("attack-002", "T1055", "exact_attack_id", "attack_technique", "T1055", "T1055", ""),
    ("attack-003", "T1218.011", "exact_attack_id", "attack_technique", "T1218.011", "T1218.011", ""),
    ("attack-004", "T1547.001", "exact_attack_id", "attack_technique", "T1547.001", "T1547.001", ""),
    ("attack-005", "T1003", "exact_attack_id", "attack_technique", "T1003", "T1003", ""),
    ("name-001", "PowerShell", "technique_name", "technique_name", "PowerShell", "", ""),
    ("name-002", "Process Injection", "technique_name", "technique_name", "Process Injection", "", ""),
    ("name-003", "OS Credential Dumping", "technique_name", "technique_name", "OS Credential Dumping", "", ""),
    ("name-004", "Windows Command Shell", "technique_name", "technique_name", "Windows Command Shell", "", ""),
    ("detect-001", "detect encoded powershell command execution", "detection_behaviour", "attack_technique", "T1059.001", "T1059.001", ""),
    ("detect-002", "detect credential dumping from lsass memory", "detection_behaviour", "attack_technique", "T1003", "T1003", ""),
    ("detect-003", "detect registry run key persistence", "detection_behaviour", "attack_technique", "T1547.001", "T1547.001", ""),
    ("detect-004", "detect suspicious rundll32 execution", "detection_behaviour", "attack_technique", "T1218.011", "T1218.011", ""),
    ("cmd-001", "rundll32.exe", "command_process", "lolbas_binary", "rundll32.exe", "", ""),
    ("cmd-002", "certutil download file", "command_process", "lolbas_binary", "certutil.exe", "", ""),
    ("cmd-003", "wmic process call create", "command_process", "lolbas_binary", "wmic.exe", "", ""),
    ("net-001", "destination.ip", "network", "ecs_field", "destination.ip", "", "destination.ip"),
    ("net-002", "network.protocol", "network", "ecs_field", "network.protocol", "", "network.protocol"),
    ("net-003", "destination.port", "network", "ecs_field", "destination.port", "", "destination.port"),
    ("ecs-001", "process.command_line", "ecs_field", "ecs_field", "process.command_line", "", "process.command_line"),
    ("ecs-002", "process.name", "ecs_field", "ecs_field", "process.name", "", "process.name"),
    ("ecs-003", "event.code", "ecs_field", "ecs_field", "event.code", "", "event.code"),
    ("ecs-004", "user.name", "ecs_field", "ecs_field", "user.name", "", "user.name"),
    ("sigma-001", "sigma rule scheduled task creation persistence", "sigma_detection", "attack_technique", "T1053.005", "T1053.005", ""),
    ("sigma-002", "sigma signed binary proxy execution", "sigma_detection", "attack_technique", "T1218", "T1218", ""),
    ("elastic-001", "elastic eql rule masquerading system32 dll", "elastic_detection", "attack_technique", "T1036", "T1036", ""),
    ("elastic-002", "elastic detection suspicious child process of office application", "elastic_detection", "attack_technique", "T1204.002", "T1204.002", ""),
    ("lolbas-001", "regsvr32.exe", "lolbas", "lolbas_binary", "regsvr32.exe", "", ""),
    ("lolbas-002", "msbuild.exe", "lolbas", "lolbas_binary", "msbuild.exe", "", ""),
    ("lolbas-003", "powershell.exe living off the land", "lolbas", "lolbas_binary", "powershell.exe", "", ""),
    ("multi-001", "powershell encoded command T1059.001", "multi_entity", "attack_technique", "T1059.001", "T1059.001", "process.command_line"),
    ("multi-002", "rundll32 T1218.011 process.command_line", "multi_entity", "attack_technique", "T1218.011", "T1218.011", "process.command_line"),
    ("unresolved-001", "T1562 impair defenses", "unresolved_reference", "citing_records_only", "T1562", "T1562", ""),
    ("unresolved-002", "T1562.001 disable security tools", "unresolved_reference", "citing_records_only", "T1562.001", "T1562.001", ""),
    ("tactic-001", "TA0011 command and control", "missing_tactic", "none_expected", "TA0011", "TA0011", ""),
    ("ambiguous-001", "M1013 application developer guidance", "ambiguous_reference", "all_candidates", "M1013", "M1013", ""),
)
#: Identifiers of the safety findings, by what is asserted of them: fixed values.
UNDEFINED, NO_TACTIC, TWICE = ("T1562", "T1562.001"), "TA0011", "M1013"
CITING = ("mitreTechniques", "mitre.techniqueId", "mitreTechnique")


def cases(spark: SparkSession, rows: tuple[tuple[str, ...], ...] = CASES) -> DataFrame:
    """``case_id, ordinal, query_text, category, rule, anchor, entity_id, field``."""
    return spark.createDataFrame([(r[0], 0, *r[1:]) for r in rows], "case_id string, ordinal int, query_text string, category string, rule string, anchor string, entity_id string, field string")


def case_queries(asked: DataFrame) -> DataFrame:
    """The cases as queries of ``retrieval``."""
    one = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return asked.select(F.col("case_id").alias("query_id"), F.col("query_text").alias("text"), one("entity_id").alias("entity_ids"), one("field").alias("canonical_fields"), none.alias("lexical_fields"), none.alias("sources"), none.alias("sections"))


def definitions(records: DataFrame) -> DataFrame:
    """What records define: ``record_id, source, identifier, name, domain`` of techniques, fields and binaries."""
    m = F.col("metadata")
    text = lambda *keys: F.coalesce(*[F.when(R.text_of(m, k) != "", R.text_of(m, k)) for k in keys])
    ident = F.when(F.col("source") == "mitre", F.upper(stripped(text("techniqueId", "id")))).when(F.col("source") == "ecs", folded(text("fieldName"))).when(F.col("source") == "lolbas", folded(text("binary", "command")))
    return records.select(F.col("id").alias("record_id"), "source", ident.alias("identifier"), F.when(F.col("source") == "mitre", folded(text("techniqueName", "name"))).alias("name"), F.coalesce(text("domain"), F.lit("?")).alias("domain")).filter("identifier IS NOT NULL OR name IS NOT NULL")


def cited(records: DataFrame) -> DataFrame:
    """``identifier, record_id, source``: what records cite in the fields that say what they detect."""
    refs = R.references(records).filter(F.col("field").isin(*CITING))
    return E.citations(refs.select("value", F.col("id").alias("record_id"), "source"))


def truth(asked: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """``case_id, record_id, grade, source``: relevance by each case's rule, the first grade of a record counts.

    A technique: 3 defines it, 2 cites it, 1 defines its parent. A name: 3 has it, 1 cites what has it. A field or a
    binary: 3. An undefined technique: 2 cites it. An ambiguous one: 3 for each that defines it. ``strict``: an anchor
    that isn't in the records (or is, where it mustn't) is an error.
    """
    known, citing = settled(definitions(records)), settled(cited(records))
    rows = asked.withColumns({"up": F.upper(stripped("anchor")), "low": folded(F.col("anchor"))})
    of = lambda *rules: rows.filter(F.col("rule").isin(*rules))
    mitre = known.filter("source = 'mitre'").select(F.col("identifier").alias("up"), "name", "record_id", "source", "domain")
    by_up = mitre.select("up", "record_id", "source")
    cites = citing.select(F.col("identifier").alias("up"), "record_id", "source")
    graded = lambda df, part, grade: df.select("case_id", "ordinal", F.lit("").alias("key"), F.lit(part).alias("part"), "record_id", "source", F.lit(grade).alias("grade"))
    parts = [graded(of("attack_technique").join(by_up, "up"), 1, 3), graded(of("attack_technique").join(cites, "up"), 2, 2)]
    parents = of("attack_technique").filter(F.col("up").contains(".")).withColumn("up", F.substring_index("up", ".", 1))
    parts.append(graded(parents.join(by_up, "up"), 3, 1))
    named = of("technique_name").drop("up").join(mitre.withColumnRenamed("name", "low"), "low")
    parts.append(named.select("case_id", "ordinal", F.col("record_id").alias("key"), F.lit(1).alias("part"), "record_id", "source", F.lit(3).alias("grade")))
    parts.append(named.select("case_id", "ordinal", F.col("record_id").alias("key"), "up").join(cites, "up").select("case_id", "ordinal", "key", F.lit(2).alias("part"), "record_id", "source", F.lit(1).alias("grade")))
    for rule, source in (("ecs_field", "ecs"), ("lolbas_binary", "lolbas")):
        parts.append(graded(of(rule).join(known.filter(F.col("source") == source).select(F.col("identifier").alias("low"), "record_id", "source"), "low"), 1, 3))
    parts.append(graded(of("citing_records_only").join(cites, "up"), 1, 2))
    parts.append(graded(of("all_candidates").join(by_up, "up"), 1, 3))
    found = reduce(DataFrame.unionByName, parts)
    if strict:
        bad = ungrounded(rows, by_up, known).select("case_id", "ordinal", F.lit("").alias("key"), F.lit(0).alias("part"), F.raise_error(F.format_string("case %s: %s", "case_id", "fault")).cast("string").alias("record_id"), F.lit("").alias("source"), F.lit(0).alias("grade"))
        found = found.unionByName(bad)
    return found.groupBy("case_id", "record_id", "source").agg(F.min_by("grade", F.struct("ordinal", "key", "part")).alias("grade"))


def ungrounded(rows: DataFrame, by_up: DataFrame, known: DataFrame) -> DataFrame:
    """``case_id, anchor, fault`` of anchors that don't stand in the records as their rule needs."""
    n = rows.join(by_up.groupBy("up").agg(F.countDistinct("record_id").alias("n_defined")), "up", "left")
    names = known.filter("source = 'mitre'").groupBy(F.col("name").alias("low")).agg(F.count(F.lit(1)).alias("n_named"))
    plain = known.filter("source IN ('ecs', 'lolbas')").groupBy(F.col("source").alias("of"), F.col("identifier").alias("low")).agg(F.count(F.lit(1)).alias("n_there"))
    n = n.join(names, "low", "left").withColumn("of", F.when(F.col("rule") == "ecs_field", "ecs").when(F.col("rule") == "lolbas_binary", "lolbas")).join(plain, ["of", "low"], "left").fillna(0, ["n_defined", "n_named", "n_there"])
    rule = F.col("rule")
    fault = F.when(~rule.isin(*RULES), F.concat(F.lit("no rule "), rule)).when((rule == "attack_technique") & (F.col("n_defined") == 0), F.concat(F.lit("nothing defines "), "anchor")).when((rule == "technique_name") & (F.col("n_named") == 0), F.concat(F.lit("nothing is called "), "anchor")).when(F.col("of").isNotNull() & (F.col("n_there") == 0), F.concat(F.lit("nothing is "), "anchor")).when((rule == "citing_records_only") & (F.col("n_defined") > 0), F.concat("anchor", F.lit(" is defined"))).when((rule == "all_candidates") & (F.col("n_defined") < 2), F.concat("anchor", F.lit(" isn't ambiguous")))
    return n.withColumn("fault", fault).filter("fault IS NOT NULL").select("case_id", "ordinal", "anchor", "fault")


def run(asked: DataFrame, judgments: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], depth: int = DEPTH, index: X.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of each case in each mode (``mode, case_id, category, skipped, p_k, r_k, ndcg_k, mrr``), and the rankings.

    Both routes run once for all modes. A case without a relevant record is skipped: it has no scores and is in no mean.
    """
    rankings = settled(Q.modes(case_queries(asked), chunks, nodes, edges, identifiers, depth, index))
    some = judgments.select("case_id", "record_id", "grade")
    scores = None
    for mode in Q.MODES:
        rows = M.measures(rankings.filter(F.col("mode") == mode).drop("mode"), some, KS).withColumn("mode", F.lit(mode))
        scores = rows if scores is None else scores.unionByName(rows)
    every = asked.select("case_id", "category").crossJoin(F.broadcast(asked.sparkSession.createDataFrame([(m,) for m in Q.MODES], "mode string")))  # three rows
    return every.join(scores, ["mode", "case_id"], "left").withColumn("skipped", F.col("mrr").isNull()), rankings


def report(scores: DataFrame, rankings: DataFrame, judgments: DataFrame, ablated: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a report says: means by mode and by category, the best mode, first-rank misses, and the worst ablation."""
    kept = scores.filter("NOT skipped")
    names = [c for c in scores.columns if c.startswith(("p_", "r_", "ndcg_")) or c == "mrr"]
    modes = M.means(kept, names, "mode")
    out = {"modes": modes, "categories": kept.groupBy("mode", "category").agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(n), 6).alias(n) for n in names]), "best": E.best_mode(modes, "ndcg_10"), "misses": first_misses(kept, rankings, judgments)}
    if ablated is not None:
        out["worst_ablation"] = worst_ablation(ablated)
    return out


def first_misses(scored: DataFrame, rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """``mode, case_id`` whose first record isn't relevant, or that found nothing."""
    hits = rankings.filter("position = 1").join(judgments.filter("grade > 0").select("case_id", "record_id"), ["case_id", "record_id"], "left_semi").select("mode", "case_id")
    return scored.select("mode", "case_id").join(hits, ["mode", "case_id"], "left_anti")


def worst_ablation(values: DataFrame, value: str = "ndcg_10") -> DataFrame:
    """Of means by ``variant`` (``full`` among them), the one that loses most, ties by name, and how much it loses."""
    full = values.filter("variant = 'full'").agg(F.first(value).alias("whole"))
    rows = values.filter("variant <> 'full'").crossJoin(F.broadcast(full)).withColumn("loss", F.round(F.col("whole") - F.col(value), 6))
    return rows.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("loss"), "variant"))).filter("nth = 1").select("variant", value, "loss")


def safety(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, identifiers: tuple[str, ...], attack_id: Column | None = None) -> DataFrame:
    """``ordinal, check, subject, passed, detail``: 16 assertions that nothing is made up.

    Undefined techniques have no node and no graph evidence, but are found by text; a tactic that the records lack isn't
    made; an ambiguous identifier keeps all its candidates; no rule has an edge to a field.
    """
    spark = chunks.sparkSession
    subjects = (*UNDEFINED, NO_TACTIC, TWICE)
    none = F.array().cast("array<string>")
    asked = spark.createDataFrame([(s,) for s in subjects], "query_id string").select("query_id", F.col("query_id").alias("text"), F.array("query_id").alias("entity_ids"), *[none.alias(c) for c in ("canonical_fields", "lexical_fields", "sources", "sections")])
    found, reports = Q.graph_route(asked, chunks, nodes, edges, identifiers)
    named = F.upper(attack_id if attack_id is not None else F.col("canonical_id"))
    count = lambda df, key: {r[0]: r[1] for r in df.groupBy(key).agg(F.count(F.lit(1))).collect()}  # noqa: E731  # a few subjects
    graph, text = count(found, "query_id"), count(Q.text_route(asked, chunks), "query_id")
    seeds = {r.query_id: r for r in reports.select("query_id", "status", "node_ids").collect()}
    made = count(nodes.filter((F.col("node_type") == "technique") & named.isin(*UNDEFINED)).select(named.alias("k")), "k")
    kinds, links = count(nodes, "node_type"), count(edges, "type")
    rows: list[tuple[str, str, bool, str]] = []
    status = lambda s: seeds[s].status if s in seeds else "absent"
    for s in UNDEFINED:
        rows += [("unresolved_seed_reported", s, status(s) == "unresolved", f"the seed is {status(s)}"), ("no_fabricated_technique_node", s, s not in made, f"{made.get(s, 0)} nodes"), ("no_fabricated_graph_evidence", s, not graph.get(s), f"{graph.get(s, 0)} items by graph"), ("text_evidence_still_available", s, bool(text.get(s)), f"{text.get(s, 0)} items by text")]
    rows += [("missing_tactic_unresolved", NO_TACTIC, status(NO_TACTIC) == "unresolved", f"the seed is {status(NO_TACTIC)}"), ("no_tactic_nodes_fabricated", NO_TACTIC, not kinds.get("tactic"), f"{kinds.get('tactic', 0)} tactics"), ("no_belongs_to_edges_fabricated", NO_TACTIC, not links.get("belongs_to"), f"{links.get('belongs_to', 0)} edges")]
    ids = list(seeds[TWICE].node_ids) if TWICE in seeds else []
    domains = sorted({i.rsplit(":", 2)[-2] for i in ids if i.count(":") >= 2})
    rows += [("ambiguity_reported", TWICE, status(TWICE) == "ambiguous", f"the seed is {status(TWICE)}"), ("all_candidates_preserved", TWICE, len(ids) == 2, ", ".join(ids)), ("no_domain_collapsed", TWICE, len(domains) == 2, ", ".join(domains)), ("no_arbitrary_selection", TWICE, not graph.get(TWICE), f"{graph.get(TWICE, 0)} items by graph")]
    rows.append(("no_fabricated_uses_field_edges", "uses_field", not links.get("uses_field"), f"{links.get('uses_field', 0)} edges"))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, check string, subject string, passed boolean, detail string")
