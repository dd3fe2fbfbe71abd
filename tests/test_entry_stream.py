import os
import tempfile

from conftest import SF_SMALL


def test_entry_returns_every_rule(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 27


def test_scan_stream_matches_batch(spark):
    from veilscan.operators import scan as S
    from veilscan.streaming.jobs import scan_stream
    src = tempfile.mkdtemp(prefix="vs-src-")
    spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").write.mode("overwrite").parquet(src)
    sink = os.path.join(tempfile.mkdtemp(prefix="vs-sink-"), "out")
    q = scan_stream(spark, src, "doc_id BIGINT, text STRING", sink)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).select("doc_id", "rule_id", "start").collect()
    batch = S.scan_text(spark.read.parquet(src)).select("doc_id", "rule_id", "start").collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))
