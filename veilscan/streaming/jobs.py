"""Structured Streaming forms of the scan, trace, taint, monitor and destination jobs.

The stateless scan is a plain ``readStream -> scan_text -> writeStream``. The
stateful jobs run the batch operators inside ``foreachBatch`` and keep what
passes from batch to batch in ``StateTable`` logs in the shared checkpoint
folder: the next call index and the first sensitive call of a session, the calls
held back for reordering, the newest pin of a tool, and the destinations seen.
A batch reads only the state of its own keys, as it was before it, so a
replayed batch gives the same result. No extra server or port is needed.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilscan.operators import pins as PN
from veilscan.operators import scan as S
from veilscan.operators import traces as TR
from veilscan.session import checkpoint_dir, materialize
from veilscan.streaming.state import StateTable, distinct_keys, newest_row


def state_root(spark: SparkSession, name: str, out_path: str | None = None) -> str:
    """State / checkpoint folder of one stream, inside the shared checkpoint folder.

    Namespaced by the stream kind and its output path: the shared folder
    outlives jobs, so two streams (or two runs writing elsewhere) must not
    resume each other's offsets or state.
    """
    root = os.path.join(checkpoint_dir(spark), "veilscan-state", name)
    return root if out_path is None else os.path.join(root, hashlib.sha1(out_path.encode()).hexdigest())


# ---------------------------------------------------------------------------
# scan_stream: stateless
# ---------------------------------------------------------------------------

def scan_stream(spark: SparkSession, source: str, schema: str, sink: str, text_col: str = "text",
                id_cols=("doc_id",), available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    src = spark.readStream.schema(schema).format(fmt).load(source)
    findings = S.scan_text(src, text_col=text_col, id_cols=list(id_cols))
    w = (findings.writeStream.format("parquet").option("path", sink)
         .outputMode("append"))
    return _started(w, state_root(spark, "scan", sink), available_now)


def _started(writer, root: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", os.path.join(root, "ckpt"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


# ---------------------------------------------------------------------------
# State tables
# ---------------------------------------------------------------------------

DEST_SCHEMA = "domain STRING"
PIN_SCHEMA = ("config_path STRING, key STRING, name STRING, description STRING, schema_canonical STRING, "
              "annotations_canonical STRING, full_hash STRING, location STRING")


def _earliest(rows: DataFrame) -> DataFrame:
    """Of each session the sensitive call with the smallest index."""
    first = rows.groupBy("session_id").agg(F.min(F.struct("first_index", "first_tool", "batch_id")).alias("_f"))
    return first.select("session_id", "_f.*")


def first_calls(spark: SparkSession, path: str, session_type: str) -> StateTable:
    return StateTable(spark, path, f"session_id {session_type}, first_index BIGINT, first_tool STRING", ["session_id"], _earliest)


def call_counts(spark: SparkSession, path: str, session_type: str) -> StateTable:
    return StateTable(spark, path, f"session_id {session_type}, next_index BIGINT", ["session_id"], newest_row(["session_id"], ["session_id", "next_index"]))


def known_destinations(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, DEST_SCHEMA, ["domain"], distinct_keys(["domain"]))


def pin_store(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, PIN_SCHEMA, ["config_path", "key"], newest_row(["config_path", "key"], ["config_path", *PN.PIN_COLS]))


# ---------------------------------------------------------------------------
# taint_stream: first sensitive call per session carried across batches
# ---------------------------------------------------------------------------

def taint_batch(batch: DataFrame, batch_id: int, state_path: str, out_path: str, known_path: str | None = None) -> None:
    """One micro-batch of already-indexed events (EVENT_COLS).

    Only the batch's own sessions are taken from the state; the session id keeps
    the batch's type. A sensitive call with a smaller index than the one known
    replaces it for the batches after. With ``known_path`` a first-seen
    destination makes a flow critical, known being what earlier batches sent to.
    """
    spark = batch.sparkSession
    flagged = TR.event_flags(batch)
    sessions = batch.select("session_id").distinct()
    firsts = first_calls(spark, state_path, dict(batch.dtypes)["session_id"])
    prior = firsts.read(batch_id, sessions)
    seed = prior.select("session_id", F.col("first_index").alias("index"), F.col("first_tool").alias("tool_name"),
                        F.lit(True).alias("reads_sensitive"), F.lit(False).alias("sends_external"),
                        F.array().cast("array<struct<domain:string,raw:string>>").alias("egress"))
    sends = flagged.select("session_id", F.col("index").cast("bigint").alias("index"), "tool_name", "reads_sensitive", "sends_external", "egress")
    destinations = None if known_path is None else known_destinations(spark, known_path)
    # only the batch's own destinations are looked up
    known = None if destinations is None else destinations.read(batch_id, TR.external_destinations(batch)).select("domain")
    toxic = TR.toxic_flows(sends.unionByName(seed), known)
    toxic.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
    here = flagged.where("reads_sensitive").groupBy("session_id").agg(F.min(F.struct(F.col("index").cast("bigint").alias("index"), "tool_name")).alias("b"))
    here = here.select("session_id", F.col("b.index").alias("first_index"), F.col("b.tool_name").alias("first_tool"))
    earlier = prior.select("session_id", F.col("first_index").alias("_known"))
    firsts.write(batch_id, here.join(earlier, "session_id", "left").where("_known IS NULL OR first_index < _known"))
    if destinations is not None:
        seen = TR.external_destinations(batch)
        destinations.write(batch_id, seen.join(known, "domain", "left_anti"))


def taint_stream(spark: SparkSession, events: DataFrame, out_path: str, available_now: bool = True,
                 novelty: bool = False) -> StreamingQuery:
    root = state_root(spark, "taint", out_path)
    state = os.path.join(root, "first_sensitive")
    known = os.path.join(root, "known") if novelty else None
    return _started(events.writeStream.foreachBatch(lambda b, i: taint_batch(b, i, state, out_path, known)), root, available_now)


# ---------------------------------------------------------------------------
# span_stream: raw span lines; call numbers and taint carried across batches
# ---------------------------------------------------------------------------

def _span_time() -> Column:
    return F.try_to_timestamp(F.col("timestamp"))


def span_batch(batch: DataFrame, batch_id: int, root: str, out_path: str, order_col: str = "line_no", session_col: str = "session_id",
               line_col: str = "line", hold_seconds: float | None = None, last: bool = False, novelty: bool = False) -> None:
    """One micro-batch of raw span lines (session, line number, line).

    The lines are parsed, a session's calls are numbered after those of earlier
    batches, and the numbered calls go through ``taint_batch``. Without
    ``hold_seconds`` lines count in the order of their numbers, and batches cut
    that order anywhere. With it calls count in the order of (timestamp, line
    number), and a call is held back until a call later by that much has been
    seen anywhere, so lines may arrive out of order by that much; ``last`` lets
    all held calls go. A call older than what has been let go is numbered where
    it arrives; a call without a readable time is not held.
    """
    spark = batch.sparkSession
    calls = TR.span_calls(batch, session_col, line_col, [order_col])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name == order_col else f"{f.name} {f.dataType.simpleString()}" for f in calls.schema.fields)
    order = [order_col]
    if hold_seconds is not None:
        held = StateTable(spark, os.path.join(root, "held"), kinds, ["session_id", order_col], lambda rows: rows)
        calls = calls.unionByName(held.read(batch_id).drop("batch_id"))
        calls = materialize(calls.withColumn("_time", _span_time()))
        newest = calls.agg(F.max(F.unix_micros("_time"))).first()[0]
        mark = max((m for m in (newest, held.meta(batch_id).get("newest")) if m is not None), default=None)
        free = F.lit(True) if last or mark is None else F.col("_time").isNull() | (F.unix_micros("_time") <= mark - int(hold_seconds * 1_000_000))
        held.write(batch_id, calls.where(~free), {"newest": mark}, replace=True)
        calls = calls.where(free)
        order = ["_time", order_col]
    numbered = materialize(TR.sequence_within(calls, "session_id", order).drop("_time"))
    counts = call_counts(spark, os.path.join(root, "counts"), dict(numbered.dtypes)["session_id"])
    before = counts.read(batch_id, numbered.select("session_id").distinct()).select("session_id", "next_index")
    numbered = numbered.join(before, "session_id", "left")
    numbered = numbered.withColumn("index", F.col("index") + F.coalesce("next_index", F.lit(0))).select(*TR.EVENT_COLS)
    taint_batch(numbered, batch_id, os.path.join(root, "first_sensitive"), out_path, os.path.join(root, "known") if novelty else None)
    counts.write(batch_id, numbered.groupBy("session_id").agg((F.max("index") + 1).alias("next_index")))


def span_stream(spark: SparkSession, lines: DataFrame, out_path: str, order_col: str = "line_no", session_col: str = "session_id", line_col: str = "line",
                hold_seconds: float | None = None, available_now: bool = True, novelty: bool = False) -> StreamingQuery:
    """Toxic flows of a stream of span lines, as ``toxic_flows`` over ``ingest_spans`` of all of them gives."""
    root = state_root(spark, "spans", out_path)
    run = lambda b, i: span_batch(b, i, root, out_path, order_col, session_col, line_col, hold_seconds, False, novelty)
    return _started(lines.writeStream.foreachBatch(run), root, available_now)


# ---------------------------------------------------------------------------
# monitor_stream: pins store advanced per batch of (config_path, doc)
# ---------------------------------------------------------------------------

def latest_pins(spark: SparkSession, store_path: str, before: int) -> DataFrame:
    return pin_store(spark, store_path).read(before).select("config_path", *PN.PIN_COLS)


def monitor_batch(batch: DataFrame, batch_id: int, store_path: str, out_path: str, order_col: str | None = None) -> None:
    """One monitoring pass; documents of one path are taken in ``order_col`` order."""
    store = pin_store(batch.sparkSession, store_path)
    current = materialize(PN.collect_tools(batch, carry=[order_col] if order_col else []))
    pinned = store.read(batch_id, current.select("config_path", "key")).select("config_path", *PN.PIN_COLS)
    findings, _newly, next_store = PN.monitor(current, pinned, order_col=order_col)
    findings.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
    # only the advanced pins are new state
    store.write(batch_id, next_store.join(pinned, list(next_store.columns), "left_anti"))


def monitor_stream(spark: SparkSession, docs: DataFrame, out_path: str, available_now: bool = True, order_col: str | None = None) -> StreamingQuery:
    root = state_root(spark, "monitor", out_path)
    store = os.path.join(root, "pins")
    return _started(docs.writeStream.foreachBatch(lambda b, i: monitor_batch(b, i, store, out_path, order_col)), root, available_now)


# ---------------------------------------------------------------------------
# destinations_stream: novelty uses the known set from before the batch
# ---------------------------------------------------------------------------

def destinations_batch(batch: DataFrame, batch_id: int, known_path: str, out_path: str) -> None:
    """Flows of a batch with novelty; a session's sensitive read may lie in an earlier batch."""
    taint_batch(batch, batch_id, known_path.rstrip("/") + "-first-sensitive", out_path, known_path)


def destinations_stream(spark: SparkSession, events: DataFrame, out_path: str,
                        available_now: bool = True) -> StreamingQuery:
    root = state_root(spark, "destinations", out_path)
    known = os.path.join(root, "known")
    return _started(events.writeStream.foreachBatch(lambda b, i: destinations_batch(b, i, known, out_path)), root, available_now)
