"""Stateful streaming jobs must give the batch answer when fed in order."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_taint_stream_matches_batch(spark):
    from veilscan.operators import traces as TR
    from veilscan.plans import catalog as C
    from veilscan.streaming.jobs import taint_stream
    ev = C.trace_events(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="vs-taint-src-")
    # three files in index order; one file per micro-batch
    import time
    now = time.time()
    for k, (lo, hi) in enumerate([(0, 3), (3, 8), (8, 1 << 30)]):
        d = os.path.join(src, f"part{k}")
        ev.where((F.col("index") >= lo) & (F.col("index") < hi)).coalesce(1).write.parquet(d)
        for f in os.listdir(d):  # the file source orders by modification time
            os.utime(os.path.join(d, f), (now - 600 + 100 * k, now - 600 + 100 * k))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = tempfile.mkdtemp(prefix="vs-taint-out-")
    q = taint_stream(spark, stream, out)
    q.awaitTermination(600)
    got = spark.read.parquet(out)
    want = TR.toxic_flows(TR.event_flags(ev))
    cols = ["session_id", "event_indexes", "severity", "evidence"]
    assert _rows(got, cols) == _rows(want, cols)
    assert got.count() > 0


def test_monitor_stream_matches_batch(spark):
    from veilscan.operators import pins as PN
    from veilscan.plans import catalog as C
    from veilscan.streaming.jobs import monitor_stream
    from veilscan.operators import tooldocs as TD
    base = C._part_snapshot(spark, SF_SMALL, current=False).select("config_path", "raw")
    cur = C._part_snapshot(spark, SF_SMALL, current=True).select("config_path", "raw")
    src = tempfile.mkdtemp(prefix="vs-mon-src-")
    base.coalesce(1).write.parquet(os.path.join(src, "a_base"))
    cur.coalesce(1).write.parquet(os.path.join(src, "b_cur"))
    # the file source orders by modification time: make the baseline clearly older
    import time
    now = time.time()
    for sub, t in (("a_base", now - 600), ("b_cur", now)):
        for f in os.listdir(os.path.join(src, sub)):
            os.utime(os.path.join(src, sub, f), (t, t))
    stream = (spark.readStream.schema("config_path STRING, raw STRING").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = tempfile.mkdtemp(prefix="vs-mon-out-")
    q = monitor_stream(spark, TD.parse_documents(stream), out)
    q.awaitTermination(600)
    got = spark.read.parquet(out)
    findings, _n, _s = PN.monitor(C.part_pins(spark, SF_SMALL, True), C.part_pins(spark, SF_SMALL, False))
    cols = ["config_path", "key", "rule_id", "severity", "location"]
    assert _rows(got, cols) == _rows(findings, cols)
    assert got.count() > 0
