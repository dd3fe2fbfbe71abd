"""Registered queries through the sources, sinks and streams: written by one job, read back by another.

The files are made from the driver tables in a folder of their own under the
checkpoint folder; what is returned was read from them by the library's readers
or produced by its streaming jobs.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.operators import audit as AU
from veilscan.operators import pins as PN
from veilscan.operators import report as RP
from veilscan.operators import scan as S
from veilscan.operators import tooldocs as TD
from veilscan.operators import traces as TR
from veilscan.plans import catalog as C
from veilscan.plans import sql as Q
from veilscan.plans.catalog import register
from veilscan.plans.fixtures import LABELLED_CASES
from veilscan.session import StagedFiles, checkpoint_dir
from veilscan.sources import readers, writers
from veilscan.streaming import jobs


def folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "veilscan-roundtrips", f"{name}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------------------
# 2.1 / 2.2 sources and sinks
# ---------------------------------------------------------------------------

@register("findings_written", C.FINDINGS_SQL)
def findings_written(spark, sf_dir):
    """Findings table written as JSON lines and read back."""
    found, path = S.scan_text(C.texts(spark, sf_dir)), folder(spark, "findings")
    writers.write_findings(found, path, fmt="json")
    return spark.read.schema(found.schema).json(path).select(*found.columns)


@register("hook_texts", """
SELECT text FROM documents WHERE length(text) > 0 AND doc_id % 7 <> 5""")
def hook_texts(spark, sf_dir):
    """Hook payload lines, the text under each of the known fields (or none of them), read as texts."""
    docs = readers.read_table(spark, sf_dir, "documents", ["doc_id", "text"], balance=True)
    turn, text = F.col("doc_id") % 7, F.col("text")
    late = F.lit("the field before this one counts")
    fields = [F.when(turn == k, text).alias(name) for k, name in enumerate(readers.HOOK_TEXT_FIELDS)]
    # the sixth kind has no known field, the seventh two of them
    fields[1] = F.when((turn == 1) | (turn == 6), text).alias("user_prompt")
    fields[4] = F.when(turn == 4, text).when(turn == 6, late).alias("content")
    path = folder(spark, "hooks")
    docs.select(F.to_json(F.struct(*fields, F.lit("hook").alias("event"))).alias("value")).write.text(path)
    return readers.read_texts(spark, path, fmt="text", hook_json=True)


@register("tool_doc_files", f"SELECT doc_id, j IS NOT NULL AS parsed FROM {C.PARSED_SQL}")
def tool_doc_files(spark, sf_dir):
    """Tool documents written one a file, with comments, trailing commas and broken ones, and read back."""
    path = folder(spark, "tool-docs")
    writers.write_tool_docs(C.tool_documents(spark, sf_dir), path, packed=True)
    made = readers.read_tool_docs(spark, path)
    number = F.regexp_extract("path", r"doc_id=(-?\d+)[./][^/]*$", 1).try_cast("bigint")
    return made.select(number.alias("doc_id"), F.col("doc").isNotNull().alias("parsed"))


@register("audit_files", """
SELECT CAST(user_id AS VARCHAR) AS session_id, true AS ok, count(*) + 2 AS n_records FROM events GROUP BY user_id""")
def audit_files(spark, sf_dir):
    """Audit logs written as JSON lines, read back by line and verified: a start, a record a call and a close."""
    path = folder(spark, "audit")
    with StagedFiles(spark) as stage:
        writers.write_audit_log(C.audit_log(spark, sf_dir, stage), path, packed=True, whole=True)
    checked = AU.verify_audit_log(readers.read_audit_log(spark, path), "log_path", "pos", "raw")
    name = F.regexp_extract("session_id", r"session_id=([^/]+?)(\.jsonl\.gz$|/)", 1)
    return checked.select(F.when(~name.isin(writers.NULL_NAMES), name).alias("session_id"), "ok", "n_records")


@register("audit_table", """
SELECT user_id AS session_id, true AS ok, count(*) + 2 AS n_records FROM events GROUP BY user_id""")
def audit_table(spark, sf_dir):
    """The same logs with many sessions a file, read back and verified."""
    path = folder(spark, "audit-table")
    writers.write_audit_table(C.audit_log(spark, sf_dir), path)
    return AU.verify_audit_log(readers.read_audit_table(spark, path), "log_path", "pos", "raw").select("session_id", "ok", "n_records")


@register("pins_lock", f"""
SELECT 'newest' AS lock, * FROM {C.PINS_CUR_SQL} UNION ALL SELECT 'first' AS lock, * FROM {C.PINS_BASE_SQL}""")
def pins_lock(spark, sf_dir):
    """Two snapshots saved as lock versions: the newest one by its pointer, the first one by name."""
    root = folder(spark, "pins")
    writers.save_pins(C.part_pins(spark, sf_dir, False), root, "a")
    writers.save_pins(C.part_pins(spark, sf_dir, True), root, "b")
    newest, first = writers.load_pins(spark, root), writers.load_pins(spark, root, "a")
    return newest.select(F.lit("newest").alias("lock"), "*").unionByName(first.select(F.lit("first").alias("lock"), "*"))


_KNOWN_SQL = f"SELECT DISTINCT lower(regexp_extract(url, {Q.q(C._URL_RE2)}, 1)) AS domain FROM pages WHERE contains(url, '/en/')"


@register("destinations_saved", f"SELECT domain FROM ({_KNOWN_SQL}) UNION SELECT domain FROM ({C.ORACLE['external_destinations']})")
def destinations_saved(spark, sf_dir):
    """The known destinations, read from their JSON list, joined by those of the traces and saved as a new version."""
    path = folder(spark, "known")
    # the file format is one list; its length is the number of distinct hosts
    C.known_destinations(spark, sf_dir).agg(F.to_json(F.collect_set("domain")).alias("value")).write.text(path)
    known = readers.load_string_list(spark, path, "domain")
    return writers.save_known_destinations(known, C.external_destinations(spark, sf_dir), folder(spark, "known-next"))


_PAGE_FINDINGS = Q.findings_sql("pages", ["page_id"], "html")


@register("tokens_allowed", f"""
SELECT DISTINCT 'sha256:' || sha256(matched) AS token_hash FROM (
  SELECT matched FROM ({_PAGE_FINDINGS}) UNION ALL SELECT matched FROM ({C.FINDINGS_SQL}))""")
def tokens_allowed(spark, sf_dir):
    """Allowlist made of the matches in pages, then joined by those in texts; a token counts once."""
    none = readers.load_string_list(spark, None, "token_hash")
    allowed = writers.allow_tokens(none, C.pages_findings(spark, sf_dir), "matched")
    return writers.allow_tokens(allowed, S.scan_text(C.texts(spark, sf_dir)), "matched")


@register("manifest_file", """
SELECT 'server-' || doc_id AS name, 'docs/' || doc_id || '.json' AS source,
  CASE WHEN toxic = 0 THEN 'https://example.net/' || doc_id END AS homepage FROM labels""")
def manifest_file(spark, sf_dir):
    """Registry manifests ({servers: [...]}) written from the labels, a bounded number of servers a file, and read back."""
    labels = readers.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    number = F.col("doc_id").cast("string")
    server = F.struct(F.concat(F.lit("server-"), number).alias("name"), F.concat(F.lit("docs/"), number, F.lit(".json")).alias("source"),
                      F.when(F.col("toxic") == 0, F.concat(F.lit("https://example.net/"), number)).alias("homepage"))
    files = labels.groupBy(F.expr("doc_id DIV 500").alias("part")).agg(F.collect_list(server).alias("servers"))
    path = folder(spark, "manifest")
    files.select("part", F.to_json(F.struct("servers")).alias("value")).write.partitionBy("part").text(path)
    return readers.load_manifest(spark, f"{path}/*")


_CASE_ROWS = ", ".join(f"({d}, {m}, true)" for d, m, *_ in LABELLED_CASES)


@register("corpus_cases", f"""
{C.ORACLE['evaluate_rules']}
UNION ALL SELECT CAST(doc_id AS BIGINT), malicious, pass FROM (VALUES {_CASE_ROWS}) AS v(doc_id, malicious, pass)""")
def corpus_cases(spark, sf_dir):
    """Labelled case files read back and scored: the labels' documents, and the own cases with expected findings and
    pins, all of which must pass."""
    labels = readers.read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    made = C.tool_documents(spark, sf_dir).join(labels, "doc_id", "right")
    none = F.lit(None).cast("string")
    made = made.select("doc_id", (F.col("toxic") == 1).alias("malicious"), none.alias("category"), none.alias("rule"), "raw", none.alias("pin"))
    own = spark.createDataFrame(LABELLED_CASES, "doc_id BIGINT, malicious BOOLEAN, category STRING, rule STRING, raw STRING, pin STRING")
    rows = made.unionByName(own)
    expect = F.when(F.coalesce("category", "rule").isNotNull(), F.struct("category", F.col("rule").alias("ruleId")))
    case = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("case").alias("title"), "malicious", expect.alias("expect"),
                    F.try_parse_json("raw").alias("doc"), F.try_parse_json("pin").alias("pin"))
    path = folder(spark, "corpus")
    files = rows.select(F.expr("doc_id DIV 50").alias("part"), F.to_json(case).alias("c")).groupBy("part").agg(F.collect_list("c").alias("c"))
    files.select("part", F.concat(F.lit('{"cases": ['), F.array_join("c", ", "), F.lit("]}")).alias("value")).write.partitionBy("part").text(path)
    cases = writers.load_corpus(spark, f"{path}/*").select(F.col("id").cast("bigint").alias("doc_id"), "malicious", "expect_category", "expect_rule_id", "raw", "pin_raw")
    docs = TD.parse_documents(cases.where("raw IS NOT NULL AND raw <> 'null'"))
    pinned = docs.where("pin_raw IS NOT NULL AND pin_raw <> 'null'")
    lock = PN.collect_tools(TD.parse_documents(pinned.select("doc_id", "pin_raw"), "pin_raw"), "doc_id")
    drift = PN.diff_pins(PN.collect_tools(pinned, "doc_id"), lock, keys=("doc_id", "key"))
    per_case, _summary = RP.evaluate_rules(cases, TD.scan_documents(docs), pin_findings=drift)
    return per_case.select("doc_id", "malicious", "pass")


# ---------------------------------------------------------------------------
# 2.4 / 2.12 order of findings, configuration summary
# ---------------------------------------------------------------------------

@register("worst_findings", f"""
SELECT * FROM ({C.FINDINGS_SQL}) ORDER BY severity_rank DESC, rule_ord, doc_id, start LIMIT 100""")
def worst_findings(spark, sf_dir):
    """Report of the hundred worst findings in report order."""
    return S.order_findings(S.scan_text(C.texts(spark, sf_dir)), ("rule_ord", "doc_id", "start")).limit(100)


@register("session_summary", f"""
WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS config_path, 1 AS static, 0 AS drift FROM {C.ALL_TOOL_FINDINGS_SQL}
           WHERE severity_rank >= 3 AND category <> 'parse_warning'
           UNION ALL SELECT config_path, 0, 1 FROM ({C.ORACLE['pins_diff']}) WHERE severity IN ('high', 'critical'))
SELECT config_path, CAST(sum(static) AS BIGINT) AS static, CAST(sum(drift) AS BIGINT) AS drift, count(*) AS total FROM f GROUP BY config_path""")
def session_summary(spark, sf_dir):
    """High and critical findings of every configuration: those in its text and those of its drift."""
    static = C.tool_findings(spark, sf_dir).withColumn("config_path", F.col("doc_id").cast("string"))
    drift = PN.diff_pins(C.part_pins(spark, sf_dir, True), C.part_pins(spark, sf_dir, False))
    return RP.session_summary(static, drift, "config_path")


# ---------------------------------------------------------------------------
# 2.13 streams
# ---------------------------------------------------------------------------

def ended(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("scan_streamed", Q.findings_sql("documents", ["doc_id"], "text"))
def scan_streamed(spark, sf_dir):
    """The scan as a stream over files that arrive in two portions."""
    docs = readers.read_table(spark, sf_dir, "documents", ["doc_id", "text"], balance=True)
    source, sink = folder(spark, "scan-in"), folder(spark, "scan-out")
    for part in range(2):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).write.mode("append").parquet(source)
        ended(jobs.scan_stream(spark, source, docs.schema.simpleString()[len("struct<"):-1].replace(":", " "), sink))
    return spark.read.parquet(sink)


def _batches(spark: SparkSession, out: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


@register("taint_streamed", C._toxic_sql(False))
def taint_streamed(spark, sf_dir):
    """Toxic flows of the calls as a stream in three portions by call number: a read taints sends of later portions."""
    events = C.trace_events(spark, sf_dir)
    source, out = folder(spark, "taint-in"), folder(spark, "taint-out")
    number = F.col("index")
    for part in (number < 3, (number >= 3) & (number < 9), number >= 9):
        events.where(part).write.mode("append").parquet(source)
        ended(jobs.taint_stream(spark, spark.readStream.schema(events.schema).parquet(source), out))
    return _batches(spark, out, TR.toxic_flows(TR.event_flags(events)).schema)


@register("spans_streamed", C._toxic_sql(False))
def spans_streamed(spark, sf_dir):
    """The same flows from raw span lines: calls are numbered and tainted across three portions by time."""
    lines = C.trace_spans(spark, sf_dir)
    lines = lines.select("session_id", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 19, "0")).alias("line_no"), "line")
    edges = lines.select(F.expr("percentile_approx(unix_micros(to_timestamp(substr(line_no, 1, 26))), array(0.3, 0.7))")).first()[0] or [0, 0]
    time = F.expr("unix_micros(to_timestamp(substr(line_no, 1, 26)))")
    source, out = folder(spark, "spans-in"), folder(spark, "spans-out")
    for part in (time < edges[0], (time >= edges[0]) & (time < edges[1]), time >= edges[1]):
        lines.where(part).write.mode("append").parquet(source)
        ended(jobs.span_stream(spark, spark.readStream.schema(lines.schema).parquet(source), out))
    return _batches(spark, out, TR.toxic_flows(TR.event_flags(C.trace_events(spark, sf_dir))).schema)



@register("monitor_streamed", C.ORACLE["monitor_pass"])
def monitor_streamed(spark, sf_dir):
    """Pins advanced by a stream of tool documents: the second snapshot's drift against the first one."""
    source, out = folder(spark, "monitor-in"), folder(spark, "monitor-out")
    for current in (False, True):
        C._part_snapshot(spark, sf_dir, current).select("config_path", "raw").write.mode("append").parquet(source)
        docs = TD.parse_documents(spark.readStream.schema("config_path STRING, raw STRING").parquet(source))
        ended(jobs.monitor_stream(spark, docs, out))
    found, _newly, _store = PN.monitor(C.part_pins(spark, sf_dir, True), C.part_pins(spark, sf_dir, False))
    return _batches(spark, out, found.schema).select(*C._DIFF_COLS)
