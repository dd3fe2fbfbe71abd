"""Reporting: SARIF output, safety leaderboard, rule evaluation, severity gates.

All are aggregations over finding tables with partial (map-side) aggregation;
per-document "worst" picks use ``min_by`` / ``max`` instead of sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
TOOL_NAME = "veilscan"


def sarif_level(sev):
    return (F.when(sev.isin("critical", "high"), F.lit("error")).when(sev == "medium", F.lit("warning"))
             .otherwise(F.lit("note")))


def to_sarif(findings: DataFrame, artifact_col: str = "doc_id"):
    """(results table, rules table, one SARIF 2.1.0 JSON document per artifact).

    Rules: one row per rule id; name/texts from its first finding (smallest
    (artifact, location)). The document column nests only that artifact's
    findings (bounded by one document's findings).
    """
    message = F.concat(F.col("title"), F.lit(" at "), F.col("location"), F.lit(": "), F.col("explanation"),
                       F.lit(" (evidence: "), F.col("evidence"), F.lit(")"))
    res = findings.select(
        artifact_col, "rule_id", sarif_level(F.col("severity")).alias("level"), message.alias("message"),
        "location", "severity", "confidence", "owasp", "category")
    first = F.min_by(F.struct("title", "explanation", "owasp", "category"), F.struct(artifact_col, "location"))

    def rule_struct(rule_id):
        return F.struct(
            rule_id.alias("id"), F.col("f.title").alias("name"),
            F.struct(F.col("f.title").alias("text")).alias("shortDescription"),
            F.struct(F.col("f.explanation").alias("text")).alias("fullDescription"),
            F.struct(F.col("f.owasp").alias("owasp"), F.col("f.category").alias("category")).alias("properties"))

    rules = findings.groupBy("rule_id").agg(first.alias("f")).select(rule_struct(F.col("rule_id")).alias("r")).select("r.*")
    result_struct = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("level").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(
            F.struct(F.struct(F.col(artifact_col).cast("string").alias("uri")).alias("artifactLocation"))
            .alias("physicalLocation"),
            F.array(F.struct(F.col("location").alias("fullyQualifiedName"))).alias("logicalLocations"))).alias("locations"),
        F.struct("severity", "confidence", "owasp", "category").alias("properties"))
    # one pass over the findings: the results of a rule in an artifact, then the artifact's results and its own rules
    # (each described by its first finding there; bounded by the rule lists)
    described = findings.withColumn("level", sarif_level(F.col("severity"))).withColumn("message", message)
    own = described.groupBy(artifact_col, "rule_id").agg(first.alias("f"), F.collect_list(result_struct).alias("of_rule"))
    per_doc = own.groupBy(artifact_col).agg(F.sort_array(F.flatten(F.collect_list("of_rule"))).alias("results"),
                                            F.sort_array(F.collect_list(rule_struct(F.col("rule_id")))).alias("rules"))
    doc = per_doc.select(artifact_col, F.to_json(F.struct(
        F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"),
        F.array(F.struct(F.struct(F.struct(F.lit(TOOL_NAME).alias("name"), F.col("rules").alias("rules")).alias("driver")).alias("tool"),
                         F.col("results").alias("results"))).alias("runs"))).alias("sarif"))
    return res, rules, doc


def severity_rollup(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return findings.groupBy(id_col).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
        F.min_by(F.concat(F.col("title"), F.lit(" ("), F.col("severity"), F.lit(")")),
                 F.struct((-F.col("severity_rank")).alias("r"), "location", "rule_id", "evidence")).alias("top_issue"))


def safety_leaderboard(manifest: DataFrame, docs: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per manifest entry: verdict BLOCKED/WARN/CLEAN (ERROR when its document is missing),
    severity counts (parse warnings excluded), top issue and the verdict sort key."""
    f = severity_rollup(findings.where(F.col("category") != "parse_warning"), id_col)
    have = docs.select(id_col).distinct().withColumn("readable", F.lit(True))
    m = manifest.join(have, id_col, "left").join(f, id_col, "left")
    readable = F.coalesce(F.col("readable"), F.lit(False))
    c = {s: F.coalesce(F.col(s), F.lit(0)) for s in ("critical", "high", "medium", "low")}
    verdict = (F.when(~readable, "ERROR").when(c["critical"] > 0, "BLOCKED").when(c["high"] > 0, "WARN")
                .otherwise("CLEAN"))
    order = F.when(~readable, 2).when(c["critical"] > 0, 0).when(c["high"] > 0, 1).otherwise(3)
    return m.select(id_col, "name", verdict.alias("verdict"), *[c[s].alias(s) for s in c],
                    F.when(~readable, F.concat(F.lit("could not read "), F.col("name")))
                     .otherwise(F.coalesce("top_issue", F.lit("none"))).alias("top_issue"),
                    order.alias("verdict_order"))


def evaluate_rules(cases: DataFrame, findings: DataFrame, id_col: str = "doc_id",
                   pin_findings: DataFrame | None = None):
    """Per case pass/fail and one summary row (recall, false positives).

    A malicious case passes on a finding that has its expected category and
    rule id (``expect_category``, ``expect_rule_id``; a null one fits any), or,
    expecting nothing in particular, on any finding >= high. A benign case passes
    when nothing >= medium fired. Cases that carry a pin add their drift
    findings (``pin_findings``: ``diff_pins`` of the case document against its
    pin, keyed by the same id). Reasons list distinct rule ids in order.
    """
    cols = [id_col, "category", "rule_id", "severity_rank"]

    def known(df):  # findings without a category fit no expected one
        return (df if "category" in df.columns else df.withColumn("category", F.lit(None).cast("string"))).select(*cols)

    findings = known(findings) if pin_findings is None else known(findings).unionByName(known(pin_findings))
    for col in ("expect_category", "expect_rule_id"):
        if col not in cases.columns:
            cases = cases.withColumn(col, F.lit(None).cast("string"))
    category, rule = F.col("expect_category"), F.col("expect_rule_id")
    free = category.isNull() & rule.isNull()
    fits = F.when(free, F.col("severity_rank") >= 3).otherwise(
        (category.isNull() | (F.col("category") == category)) & (rule.isNull() | (F.col("rule_id") == rule)))
    tripped = F.when(F.col("severity_rank") >= 2, F.col("rule_id"))
    got = findings.join(cases.select(id_col, "expect_category", "expect_rule_id"), id_col).groupBy(id_col).agg(
        F.max(fits).alias("fits"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.array_sort(F.collect_set(tripped)).alias("tripped"))
    c = cases.join(got, id_col, "left")
    n_tripped = F.coalesce(F.size("tripped"), F.lit(0))
    passed = F.when(F.col("malicious"), F.coalesce("fits", F.lit(False))).otherwise(n_tripped <= 0)
    wanted = F.when(free, F.lit('"high+"')).otherwise(F.to_json(F.struct(category.alias("category"), rule.alias("ruleId"))))
    ids = F.coalesce(F.nullif(F.array_join("rule_ids", ", "), F.lit("")), F.lit("nothing"))
    reason = (F.when(F.col("malicious") & passed, F.lit("detected"))
               .when(F.col("malicious"), F.concat(F.lit("MISS: expected "), wanted, F.lit(", got ["), ids, F.lit("]")))
               .when(passed, F.lit("clean (no false positive)"))
               .otherwise(F.concat(F.lit("FALSE POSITIVE: "), F.array_join("tripped", ", "))))
    per_case = c.select(id_col, "malicious", passed.alias("pass"), reason.alias("reason"))
    m = F.col("malicious")
    summary = per_case.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(m).alias("malicious"), F.count_if(~m).alias("benign"),
        F.count_if(m & F.col("pass")).alias("detected"), F.count_if(~m & ~F.col("pass")).alias("false_positives"))
    summary = summary.withColumn("recall", F.when(F.col("malicious") == 0, F.lit(1.0))
                                 .otherwise(F.col("detected") / F.col("malicious")))
    return per_case, summary


def session_summary(static_findings: DataFrame, drift_findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per config: high/critical static findings (parse warnings excluded) plus high/critical drift."""
    hi = F.col("severity_rank") >= 3
    s = static_findings.where(hi & (F.col("category") != "parse_warning")).select(id_col, F.lit("static").alias("kind"))
    d = drift_findings.where(hi).select(id_col, F.lit("drift").alias("kind"))
    u = s.unionByName(d)
    return u.groupBy(id_col).agg(F.count_if(F.col("kind") == "static").alias("static"),
                                 F.count_if(F.col("kind") == "drift").alias("drift"),
                                 F.count(F.lit(1)).alias("total"))


