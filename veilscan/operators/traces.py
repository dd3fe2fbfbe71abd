"""Tool-call trace analytics: ingest spans, secrets and sinks per call,
cross-call taint (sensitive read followed by external send), novelty against
known destinations, trust levels.

Skew: one session may hold a third of all spans. Nothing here puts a whole
session into one task: the per-session call index is computed with a range
partitioning that splits hot sessions (``sequence_within``), and the taint
source of a session is a partial aggregate (min) joined back on the session.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veilscan.functions.regex import explode_rows, q_ident, sql_str

from veilscan.operators import entropy as EN
from veilscan.operators import scan as S
from veilscan.operators.tooldocs import _finding
from veilscan.session import CHECKPOINTS, Checkpoints, allow_duplicate_keys

# ---------------------------------------------------------------------------
# Sink hosts, URL / sensitive / send patterns.
# ---------------------------------------------------------------------------
SUSPICIOUS_SINKS = ["webhook.site", "requestbin", "pipedream.net", "ngrok.io", "ngrok-free.app",
                    "burpcollaborator", "oast.fun", "oast.site", "interact.sh", "requestcatcher.com"]
URL_PATTERN = r"\bhttps?:\/\/([a-z0-9.-]+|\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?[^\s\"'`]*"
RAW_IP_HOST = r"^\d{1,3}(?:\.\d{1,3}){3}$"
SENSITIVE_SOURCE = r"(\.env\b|\.ssh\b|id_rsa|id_ed25519|\/etc\/passwd|credentials?|secret|private[_\s-]?key|api[_\s-]?key|password|token)"
SEND_TOOL = r"(send|post|upload|fetch|http|email|webhook|put|request|publish|push|export|transmit)"
TOOL_CALL_NAME = r"execute_tool|tools\/call|tool\.call"

SINK_EXPL = ("A tool call referenced an ephemeral request collector, tunnel, or raw IP, the kind of endpoint used to "
             "exfiltrate data. Confirm this destination is intended.")
TOXIC_EXPL = ("A tool that touched sensitive data was followed, later in the session, by a tool that sends data out. "
              "Taint is tracked across calls, so this fires even when benign tools sit between. Severity is driven "
              "by where the data went: critical to a known sink or a never-before-seen destination, high to a "
              "destination you have sent to before.")
RESULT_SUFFIX = " Appeared in a tool RESULT at runtime, which a pre-install static scan cannot see."
ARGS_SUFFIX = " Passed as a tool-call argument at runtime."

#: Slots over which the sends to one domain are spread when it is looked up.
DOMAIN_SLOTS = 32

EVENT_COLS = ["session_id", "index", "timestamp", "tool_name", "server", "arguments_text", "result_text", "outcome"]


def _j(p: str, ci: bool = False) -> str:
    from veilscan.functions.regex import to_java
    return to_java(p, ignore_case=ci)


# ---------------------------------------------------------------------------
# Skew-safe numbering inside a key
# ---------------------------------------------------------------------------

def _places(key: str):
    """Place of each row in its run of equal keys (``_at``), over the sorted rows of one partition."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        last, had = None, 0  # the last row's key, and its rows so far
        for batch in batches:
            keys, n = batch.column(key), batch.num_rows
            if not n:
                continue
            one, two = keys.slice(1), keys.slice(0, n - 1)
            same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(one.is_null(), two.is_null()))
            fresh = np.concatenate([[not had or keys[0].as_py() != last], ~same.to_numpy(zero_copy_only=False)])
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(fresh, row, -had))
            last, had = keys[-1].as_py(), int(n - start[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row - start, pa.int64())], names=[*batch.schema.names, "_at"])
    return run


def sequence_within(df: DataFrame, key: str, order: Sequence[str], out: str = "index",
                    partitions: int | None = None, stage: Checkpoints = CHECKPOINTS) -> DataFrame:
    """0-based position of each row inside its ``key`` group, by ``order``.

    Range-partitions on (key, order...) so a hot key is split across many
    partitions; each partition numbers its sorted rows by one pass. Of its keys
    only the first can have begun in an earlier partition: those offsets, one a
    partition at most, are added where the rows lie. No task ever holds a whole
    group, and the rows move once.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range partitioner samples its input: hold it so an expensive
    # input (span parsing) is evaluated once; dropped after materialising.
    src = stage.hold(df)
    ranged = src.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    # ids are position dependent: materialise once (in the shared folder) so the
    # count table and the rows agree, also after an executor loss.
    ranged = stage.keep(ranged.mapInArrow(_places(key), StructType([*ranged.schema.fields, StructField("_at", LongType())])))
    stage.free(src)
    counts = ranged.groupBy("_pid", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    begun = counts.withColumn("_off", F.sum("_cnt").over(w)).where("_off > 0").select("_pid", "_key", "_off")
    begun = begun.withColumnRenamed("_pid", "_part")
    begun = F.broadcast(spark.createDataFrame(begun.collect(), begun.schema))
    j = ranged.join(begun, (F.col("_pid") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return j.withColumn(out, (F.col("_at") + F.coalesce("_off", F.lit(0))).cast("long")).drop("_pid", "_at", "_part", "_key", "_off")


# ---------------------------------------------------------------------------
# Ingest
# ---------------------------------------------------------------------------

def _as_text(v: Column) -> Column:
    """JSON value as text: strings as-is, everything else serialised; JSON null -> NULL."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull() | (t == "VOID"), F.lit(None).cast("string"))
             .when(t == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))


def _otlp_inner(x: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(x, f"$.value.{k}", "variant")
                        for k in ("stringValue", "intValue", "boolValue", "doubleValue", "value")])


def span_attr_tables(span: Column) -> tuple[Column, Column]:
    """(flat MAP<STRING,STRING>, OTLP ARRAY<STRUCT<k,v>>) of a span's attributes, built once per span."""
    flat = F.transform_values(F.try_variant_get(span, "$.attributes", "map<string,variant>"), lambda _k, v: _as_text(v))
    arr = F.try_variant_get(span, "$.attributes", "array<variant>")
    entries = F.transform(arr, lambda x: F.struct(F.try_variant_get(x, "$.key", "string").alias("k"),
                                                  _as_text(_otlp_inner(x)).alias("v")))
    return flat, entries


def lookup_attr(flat: Column, entries: Column, key: str) -> Column:
    """Flat value when present and non-null, else the first OTLP entry with that key and a value.

    Reads the staged ``_flat`` / ``_otlp`` columns (built as SQL text: cheap to plan).
    """
    k = sql_str(key)
    return F.expr(f"coalesce(try_element_at(`_flat`, {k}), try_element_at(filter(coalesce(`_otlp`, "
                  f"CAST(array() AS array<struct<k:string,v:string>>)), e -> e.k = {k} AND e.v IS NOT NULL), 1).v)")


def span_calls(lines: DataFrame, session_col: str, line_col: str, order: Sequence[str]) -> DataFrame:
    """Tool calls of JSONL span lines with their order columns, not yet numbered."""
    allow_duplicate_keys(lines.sparkSession)
    s = lines.select(session_col, *order, F.try_parse_json(F.trim(F.col(line_col))).alias("span"))
    s = s.where(F.col("span").isNotNull())
    flat, entries = span_attr_tables(F.col("span"))
    name_v = F.try_variant_get(F.col("span"), "$.name", "variant")
    ts_v = F.try_variant_get(F.col("span"), "$.timestamp", "variant")
    # stage 1: attribute tables and top-level fields, computed once per span
    s = s.select(session_col, *order, flat.alias("_flat"), entries.alias("_otlp"),
                 F.when(F.schema_of_variant(name_v) == "STRING", F.try_variant_get(name_v, "$", "string")).alias("_name"),
                 F.when(F.schema_of_variant(ts_v) == "STRING", F.try_variant_get(ts_v, "$", "string")).alias("_ts"))
    A = lambda k: lookup_attr(F.col("_flat"), F.col("_otlp"), k)
    name = F.col("_name")
    is_call = ((F.coalesce(A("gen_ai.operation.name") == "execute_tool", F.lit(False)))
               | F.coalesce(A("mcp.method.name") == "tools/call", F.lit(False))
               | F.coalesce(name, F.lit("")).rlike(f"(?i){TOOL_CALL_NAME}"))
    ts = F.coalesce(F.nullif(F.col("_ts"), F.lit("")), F.nullif(A("timestamp"), F.lit("")), F.lit("(unknown)"))
    return s.where(is_call).select(
        F.col(session_col).alias("session_id"), *order, ts.alias("timestamp"),
        F.coalesce(A("gen_ai.tool.name"), A("tool.name"), name, F.lit("unknown")).alias("tool_name"),
        F.coalesce(A("mcp.session.id"), A("server.address")).alias("server"),
        F.coalesce(A("gen_ai.tool.call.arguments"), A("tool.arguments"), F.lit("")).alias("arguments_text"),
        F.coalesce(A("gen_ai.tool.call.result"), A("tool.result"), F.lit("")).alias("result_text"),
        F.coalesce(A("outcome"), F.lit("ok")).alias("outcome"))


def ingest_spans(lines: DataFrame, session_col: str = "session_id", line_col: str = "line",
                 order_col: str | Sequence[str] = "line_no", stage: Checkpoints = CHECKPOINTS) -> DataFrame:
    """JSONL spans -> tool-call events. Blank / invalid / non-tool-call lines are dropped;
    ``index`` numbers the kept calls of a session in line order."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    ev = span_calls(lines, session_col, line_col, order)
    # every later step reads the numbered calls as they were staged
    return sequence_within(ev, "session_id", order, stage=stage).select(*EVENT_COLS)


# ---------------------------------------------------------------------------
# Per-call columns
# ---------------------------------------------------------------------------

def extract_domains_sql(text_sql: str) -> str:
    p = _j(URL_PATTERN, ci=True)
    # the regex runs only where the text holds what stands in every URL
    return (f"CASE WHEN instr({text_sql}, '://') > 0 THEN transform(regexp_extract_all({text_sql}, {sql_str('(' + p + ')')}, 1), "
            f"r -> named_struct('domain', lower(regexp_extract(r, {sql_str(p)}, 1)), 'raw', r)) "
            f"WHEN {text_sql} IS NOT NULL THEN CAST(array() AS array<struct<domain:string,raw:string>>) END")


def extract_domains(text) -> Column:
    """ARRAY<STRUCT<domain, raw>> of URLs in the text (host lower-cased); ``text`` is a column name."""
    name = text if isinstance(text, str) else text._jc.toString()
    return F.expr(extract_domains_sql(q_ident(name)))


def _sink_sql(d: str) -> str:
    return " OR ".join([f"{d} RLIKE {sql_str(_j(RAW_IP_HOST))}"] + [f"instr({d}, {sql_str(x)}) > 0" for x in SUSPICIOUS_SINKS])


def _internal_sql(d: str) -> str:
    return (f"({d} = 'localhost' OR endswith({d}, '.local') OR endswith({d}, '.internal') OR {d} = '127.0.0.1' OR "
            f"{d} = '0.0.0.0' OR startswith({d}, '10.') OR startswith({d}, '192.168.') OR "
            f"{d} RLIKE {sql_str(r'^172\.(1[6-9]|2\d|3[01])\.')})")


def is_suspicious_sink(d: Column) -> Column:
    c = d.rlike(_j(RAW_IP_HOST))
    for s in SUSPICIOUS_SINKS:
        c = c | F.contains(d, F.lit(s))
    return c


def is_internal_domain(d: Column) -> Column:
    return ((d == "localhost") | d.endswith(".local") | d.endswith(".internal") | (d == "127.0.0.1")
            | (d == "0.0.0.0") | d.startswith("10.") | d.startswith("192.168.") | d.rlike(r"^172\.(1[6-9]|2\d|3[01])\."))


def _loc(field: Column | None = None) -> Column:
    base = F.concat(F.lit("tool_call["), F.col("index").cast("string"), F.lit("] "), F.col("tool_name"))
    return base if field is None else F.concat(base, F.lit("."), field)


def field_rows(events: DataFrame) -> DataFrame:
    """(session_id, index, tool_name, field, text) for the non-empty arguments and result."""
    f = events.select("session_id", "index", "tool_name", F.explode(F.array(
        F.struct(F.lit("arguments").alias("field"), F.col("arguments_text").alias("text")),
        F.struct(F.lit("result").alias("field"), F.col("result_text").alias("text")))).alias("f"))
    return f.select("session_id", "index", "tool_name", "f.field", "f.text").where(F.length("text") > 0)


def secret_findings(events: DataFrame) -> DataFrame:
    fr = field_rows(events).where(S.trips(F.col("text"), S.ANY_RULE))
    f = S.scan_text(fr, text_col="text", id_cols=["session_id", "index", "tool_name", "field"])
    is_res = F.col("field") == "result"
    fin = _finding(F.when(is_res, F.lit("secret_in_result")).otherwise(F.lit("secret_in_config")), F.col("rule_id"),
                   F.concat(F.lit("Secret in tool "), F.col("field"), F.lit(": "), F.col("rule_name")),
                   F.col("severity"), F.col("confidence"), _loc(F.col("field")),
                   F.when(F.length("matched") > 40, F.concat(F.substring("matched", 1, 40), F.lit("..."))).otherwise(F.col("matched")),
                   F.concat(F.col("explanation"), F.when(is_res, F.lit(RESULT_SUFFIX)).otherwise(F.lit(ARGS_SUFFIX))),
                   ("LLM06", "T2"))
    return f.select("session_id", F.array("index").alias("event_indexes"), fin.alias("f")).select(
        "session_id", "event_indexes", "f.*")


def entropy_findings(events: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """High-entropy tokens only in fields where no named rule fired (opt-in layer)."""
    fr = field_rows(events)
    fr = S.gate(fr, text_col="text").where(F.col("n_findings") == 0).drop("worst_rank", "n_findings", "gate_failed")
    t = EN.high_entropy_tokens(fr, text_col="text", id_cols=["session_id", "index", "tool_name", "field"], allowed=allowed)
    is_res = F.col("field") == "result"
    expl = F.concat(F.lit("A "), F.col("reason"), F.lit(" that matches no known key format but looks like a credential. "
                                                         "Lower confidence than a named rule. If benign, add its sha256 hash to the allowlist to suppress it."))
    fin = _finding(F.when(is_res, F.lit("secret_in_result")).otherwise(F.lit("secret_in_config")), "high_entropy_token",
                   F.concat(F.lit("Possible secret in tool "), F.col("field"), F.lit(" (high entropy)")), "medium", 0.5,
                   _loc(F.col("field")),
                   F.when(F.length("token") > 16, F.concat(F.substring("token", 1, 12), F.lit("..."))).otherwise(F.col("token")),
                   expl, ("LLM06",))
    return t.select("session_id", F.array("index").alias("event_indexes"), fin.alias("f")).select(
        "session_id", "event_indexes", "f.*")


def sink_findings(events: DataFrame) -> DataFrame:
    fr = field_rows(events).where(F.contains("text", F.lit("://")))
    u = fr.select("session_id", "index", "tool_name", "field", explode_rows(extract_domains("text")).alias("u"))
    u = u.where(F.col("u").isNotNull())
    u = u.where(is_suspicious_sink(F.col("u.domain")))
    raw = F.col("u.raw")
    fin = _finding("exfil_domain", "suspicious_sink", F.concat(F.lit("Suspicious data sink: "), F.col("u.domain")), "high",
                   0.8, _loc(F.col("field")),
                   F.when(F.length(raw) > 50, F.concat(F.substring(raw, 1, 50), F.lit("..."))).otherwise(raw),
                   SINK_EXPL, ("LLM06", "T2"))
    return u.select("session_id", F.array("index").alias("event_indexes"), fin.alias("f")).select(
        "session_id", "event_indexes", "f.*")


def event_flags(events: DataFrame, sensitive: Column | None = None, sends: Column | None = None) -> DataFrame:
    """Adds reads_sensitive, domains, egress, sends_external (row-local).

    ``sensitive`` / ``sends`` override the default predicates (Columns over the event row).
    """
    doms = F.concat(extract_domains("arguments_text"), extract_domains("result_text"))
    sens = sensitive if sensitive is not None else (
        F.col("tool_name").rlike(_j(SENSITIVE_SOURCE, True)) | F.col("arguments_text").rlike(_j(SENSITIVE_SOURCE, True))
        | (S.trips(F.col("result_text"), S.ANY_RULE) & S.any_rule_hit(F.col("result_text"))))
    out = events.withColumn("reads_sensitive", sens).withColumn("domains", doms)
    out = out.withColumn("egress", F.expr(f"filter(`domains`, d -> NOT {_internal_sql('d.domain')})"))
    default_send = F.when(F.size("domains") > 0, F.size("egress") > 0).otherwise(
        F.col("tool_name").rlike(_j(SEND_TOOL, True)))
    return out.withColumn("sends_external", sends if sends is not None else default_send)


def toxic_flows(flagged: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Sensitive read, then (later in the session) an external send.

    The taint source is the session's earliest sensitive call: a partial
    aggregate (skew-safe) joined back on the session.
    """
    first = (flagged.where("reads_sensitive").groupBy("session_id")
             .agg(F.min(F.struct("index", "tool_name")).alias("first")))
    sends = flagged.where("sends_external").select("session_id", "index", "tool_name", "egress")
    j = sends.join(first, "session_id").where(F.col("first.index") < F.col("index"))
    if known is not None:
        ex = j.select("session_id", "index", explode_rows("egress.domain").alias("d")).where(F.col("d").isNotNull())
        # each domain is looked up once, however many calls send to it
        new = ex.select("d").distinct().join(known.select(F.col("domain").alias("d")).distinct(), "d", "left_anti")
        # a domain that takes a third of all sends is spread over the slots; the looked-up side is one row a domain and slot
        ex = ex.withColumn("_slot", F.pmod(F.xxhash64("session_id", "index"), F.lit(DOMAIN_SLOTS)).cast("int"))
        new = new.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(DOMAIN_SLOTS - 1))))
        nov = ex.join(new, ["d", "_slot"]).select("session_id", "index").distinct().withColumn("novel", F.lit(True))
        j = j.join(nov, ["session_id", "index"], "left")
    else:
        j = j.withColumn("novel", F.lit(False))
    sink = F.expr(f"exists(`egress`, d -> {_sink_sql('d.domain')})")
    novel = F.coalesce(F.col("novel"), F.lit(False))
    critical = sink | novel
    hops = F.col("index") - F.col("first.index") - 1
    dests = F.expr("array_join(transform(`egress`, d -> d.domain), ', ')")
    why = (F.when(sink, F.lit("a known exfiltration sink"))
            .when(novel, F.lit("a destination never seen in prior sessions (first-seen egress of sensitive data)"))
            .otherwise(F.lit("an external destination")))
    title = F.when(hops > 0, F.concat(F.lit("Toxic flow: sensitive read, "), hops.cast("string"),
                                      F.lit(" hop(s), then external send"))).otherwise(
        F.lit("Toxic flow: sensitive read then external send"))
    evidence = F.concat(F.col("first.tool_name"), F.lit(" (sensitive) then "), F.col("tool_name"), F.lit(" to "),
                        F.when(F.length(dests) > 0, dests).otherwise(F.lit("an external destination")),
                        F.lit(" ("), why, F.lit(")"),
                        F.when(hops > 0, F.concat(F.lit(" ["), hops.cast("string"), F.lit(" intermediate call(s)]")))
                        .otherwise(F.lit("")))
    location = F.concat(F.lit("tool_call["), F.col("first.index").cast("string"), F.lit("] "), F.col("first.tool_name"),
                        F.lit(" -> tool_call["), F.col("index").cast("string"), F.lit("] "), F.col("tool_name"))
    fin = _finding("toxic_flow", "read_then_exfiltrate", title,
                   F.when(critical, F.lit("critical")).otherwise(F.lit("high")),
                   F.when(critical, F.lit(0.8)).otherwise(F.lit(0.6)), location, evidence, TOXIC_EXPL, ("LLM06", "T2"))
    return j.select("session_id", F.array(F.col("first.index"), F.col("index")).alias("event_indexes"),
                    fin.alias("f")).select("session_id", "event_indexes", "f.*")


def analyze_events(events: DataFrame, known: DataFrame | None = None, detect_entropy: bool = False,
                   allowed: DataFrame | None = None, sensitive: Column | None = None,
                   sends: Column | None = None) -> DataFrame:
    """All trace findings: (session_id, event_indexes, finding columns...)."""
    out = secret_findings(events).unionByName(sink_findings(events))
    if detect_entropy:
        out = out.unionByName(entropy_findings(events, allowed))
    return out.unionByName(toxic_flows(event_flags(events, sensitive, sends), known))


def external_destinations(events: DataFrame) -> DataFrame:
    d = events.select(explode_rows(F.concat(extract_domains("arguments_text"),
                                         extract_domains("result_text"))).alias("u"))
    return d.where(F.col("u").isNotNull()).select(F.col("u.domain").alias("domain")).where(~is_internal_domain(F.col("domain"))).distinct()


def trust_levels(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Per call: flagged rule ids (each once, sorted) with their counts, worst rank, trust
    level L0..L4 and ``n_owned`` (findings whose first referenced call is this one, so that
    summing it per session counts every finding exactly once).

    A call may be named by any number of findings (a session's first sensitive call by
    every later send): they are counted by rule first, map-side, so a call's row is as
    long as the list of rules and no longer.
    """
    ex = findings.select("session_id", F.posexplode("event_indexes").alias("pos", "index"), "rule_id", "severity_rank")
    rule = ex.groupBy("session_id", "index", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("severity_rank").alias("rank"), F.count_if(F.col("pos") == 0).alias("owned"))
    per = (rule.groupBy("session_id", "index")
           .agg(F.array_sort(F.collect_list(F.struct("rule_id", "n"))).alias("finding_counts"),
                F.max("rank").alias("worst_rank"), F.sum("owned").alias("n_owned"))
           .withColumn("finding_rule_ids", F.col("finding_counts.rule_id")))
    j = events.join(per, ["session_id", "index"], "left")
    w = F.coalesce(F.col("worst_rank"), F.lit(0))
    level = (F.when(w == 4, "L0").when(w == 3, "L1").when(w == 2, "L2").when(w == 1, "L3").otherwise("L4"))
    return (j.withColumn("finding_rule_ids", F.coalesce("finding_rule_ids", F.array().cast("array<string>")))
             .withColumn("finding_counts", F.coalesce("finding_counts", F.array().cast("array<struct<rule_id:string,n:bigint>>")))
             .withColumn("worst_rank", w).withColumn("trust_level", level)
             .withColumn("n_owned", F.coalesce("n_owned", F.lit(0))))


def every_finding(calls: DataFrame) -> DataFrame:
    """``trust_levels`` rows whose ``finding_rule_ids`` name a rule once for each finding of the call, as audit records do."""
    return calls.withColumn("finding_rule_ids", F.expr("flatten(transform(finding_counts, c -> array_repeat(c.rule_id, CAST(c.n AS INT))))"))


def session_stats(calls: DataFrame) -> DataFrame:
    """Per session: calls, findings and whether any finding is critical, from ``trust_levels`` rows."""
    return calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_calls"),
                                           F.sum("n_owned").alias("n_findings"),
                                           F.max(F.col("worst_rank") == 4).alias("any_critical"))
