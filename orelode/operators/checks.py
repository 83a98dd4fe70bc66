"""Constraint checks of replies against what was supplied, and the documents that come of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orelode.functions.text import one_space, stripped

#: Query languages of a rule's type, and bands of risk by severity: fixed values.
LANGUAGES = {"eql": ("eql",), "esql": ("esql",), "query": ("kql", "lucene"), "threshold": ("kql", "lucene"), "new_terms": ("kql", "lucene")}
RISK = {"low": (0, 21), "medium": (22, 47), "high": (48, 73), "critical": (74, 100)}
BANDS = ((95, "A+"), (85, "A"), (70, "B"), (50, "C"), (30, "D"), (0, "F"))
FP_RISK = {"critical": "high", "high": "high", "medium": "medium", "low": "low"}
CATEGORY = {"logic": "logic_error", "fields": "ecs_compliance", "false_positives": "false_positive", "false_negatives": "detection_gap", "evasion": "detection_gap", "brittleness": "detection_gap", "mitre_coverage": "coverage_gap", "noise": "false_positive", "documentation": "metadata_issue"}
PRIORITY = {"critical": 1, "high": 2, "medium": 3, "low": 4}
STORED_LANGUAGE = {"kql": "kuery", "eql": "eql", "esql": "esql", "lucene": "lucene"}
BEFORE, AFTER = r"(?<![A-Za-z0-9_.\-])", r"(?![A-Za-z0-9_\-])(?!\.[A-Za-z0-9_])"


def occurs(identifier: Column, text: Column) -> Column:
    """Whether an identifier is in a text by itself, not as part of a longer one; case counts."""
    quoted = F.regexp_replace(identifier, r"([^A-Za-z0-9_])", r"\\$1")
    return (F.length(identifier) > 0) & F.coalesce(F.regexp_like(text, F.concat(F.lit(BEFORE), quoted, F.lit(AFTER))), F.lit(False))


def looked_up(table: dict, value: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def unpadded(text: Column) -> Column:
    """White space as one blank, and none inside parentheses; quoted parts stay as they are."""
    parts = F.regexp_extract_all(one_space(text), F.lit(r"""("(?:[^"\\]|\\.)*(?:"|$)|'(?:[^'\\]|\\.)*(?:'|$)|[^"']+)"""), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[\"']"), p).otherwise(F.regexp_replace(F.regexp_replace(p, r"\( +", "("), r" +\)", ")"))), "")


def rating(score: Column) -> Column:
    """A score's letter; one out of range is an error."""
    out = F.raise_error(F.format_string("score %d is not in 0..100", score)).cast("string")
    for low, letter in reversed(BANDS):
        out = F.when(score.between(low, 100), letter).otherwise(out)
    return out


def change_label(before: Column, after: Column) -> Column:
    b, a = stripped(before), stripped(after)
    return F.when(b == "", F.concat(F.lit("Added "), a)).when(a == "", F.concat(F.lit("Removed "), b)).otherwise(F.concat(F.lit("Changed "), b, F.lit(" to "), a))


def issue(code: str, path: Column, message: Column, severity: str = "error") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"))


def rule_issues(rules: DataFrame) -> DataFrame:
    """``rule_id`` and issues of rules (type, language, severity, risk_score, query, original)."""
    type_ok = F.lit(False)
    for kind, languages in LANGUAGES.items():
        type_ok = type_ok | ((F.col("type") == kind) & F.col("language").isin(*languages))
    band = F.lit(False)
    for severity, (low, high) in RISK.items():
        band = band | ((F.col("severity") == severity) & ~F.col("risk_score").between(low, high))
    path = F.lit("rule")
    found = F.array(
        F.when(~type_ok, issue("language_mismatch", path, F.concat_ws("/", "type", "language"))),
        F.when(band, issue("risk_outside_band", path, F.concat_ws("/", "severity", F.col("risk_score").cast("string")), "warning")),
        F.when(~F.coalesce(F.col("risk_score").between(0, 100), F.lit(False)), issue("out_of_range", path, F.coalesce(F.col("risk_score").cast("string"), F.lit("null")))),
        F.when(stripped("query") == "", issue("missing_text", path, F.lit("query"))),
        F.when(unpadded(F.col("query")) == unpadded(F.col("original")), issue("rule_unchanged", path, F.lit("query"))),
    )
    return rules.select("rule_id", F.inline(F.filter(found, lambda i: i.isNotNull())))


def citation_issues(cited: DataFrame, supplied: DataFrame) -> DataFrame:
    """Cited items (reply_id, path, item_id) that weren't supplied (reply_id, item_id, text), and empty ones."""
    empty = cited.filter(F.col("item_id").isNull() | (stripped("item_id") == "")).select("reply_id", F.lit("empty_citation").alias("code"), "path", F.lit("").alias("message"))
    unknown = cited.filter(stripped("item_id") != "").join(supplied.select("reply_id", "item_id").distinct(), ["reply_id", "item_id"], "left_anti").select("reply_id", F.lit("unknown_citation").alias("code"), "path", F.col("item_id").alias("message"))
    return empty.unionByName(unknown)


def fabricated(claimed: DataFrame, supplied: DataFrame) -> DataFrame:
    """Claimed identifiers (reply_id, path, identifier) that no supplied text of the reply has by itself."""
    hits = claimed.join(supplied.select("reply_id", "text"), "reply_id").filter(occurs(F.col("identifier"), F.col("text"))).select("reply_id", "path", "identifier").distinct()
    return claimed.join(hits, ["reply_id", "path", "identifier"], "left_anti")


def ledger(items: DataFrame) -> DataFrame:
    """Uncertain seeds (package_id, ordinal, identifier, status): the first of each identifier; redirected ones aren't uncertain."""
    some = items.filter(F.col("status").isin("unresolved", "ambiguous"))
    return some.groupBy("package_id", "identifier").agg(F.min_by("status", "ordinal").alias("status"), F.min("ordinal").alias("ordinal"))


def ledger_issues(supplied: DataFrame, reported: DataFrame) -> DataFrame:
    """Uncertainties that a reply drops, invents or changes; both have (package_id, identifier, status, candidates)."""
    s = supplied.select("package_id", "identifier", F.col("status").alias("was"), F.col("candidates").alias("had"))
    r = reported.select("package_id", "identifier", F.col("status").alias("now"), F.col("candidates").alias("has"))
    both = s.join(r, ["package_id", "identifier"], "full_outer")
    code = F.when(F.col("now").isNull(), "dropped").when(F.col("was").isNull(), "invented").when(F.col("was") != F.col("now"), "changed").when(F.size(F.array_except("had", "has")) > 0, "narrowed").when(F.size(F.array_except("has", "had")) > 0, "widened")
    return both.withColumn("code", code).filter("code IS NOT NULL").select("package_id", "identifier", "code")


def reported(issues: DataFrame) -> DataFrame:
    """Issues by path, code and message, and for each reply whether it is valid: without an error."""
    return issues.groupBy("rule_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "code", "message"))), ";").alias("listing")).withColumn("valid", F.col("errors") == 0)


def mapping_document(tactic: Column, technique: Column, parent: Column, confidence: Column) -> Column:
    """A cited technique in the document's shape: with a parent it is the sub-technique."""
    has = stripped(parent) != ""
    return F.to_json(F.struct(tactic.alias("tacticId"), F.when(has, stripped(parent)).otherwise(technique).alias("techniqueId"), F.when(has, technique).alias("subTechniqueId"), F.bround(confidence * 100).cast("int").alias("confidence")), {"ignoreNullFields": "false"})
