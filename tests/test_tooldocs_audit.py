from pyspark.sql import functions as F

from veilscan.operators import tooldocs as TD
from veilscan.plans.fixtures import TOOL_DOC_FIXTURES


def _docs(spark):
    return TD.parse_documents(spark.createDataFrame(TOOL_DOC_FIXTURES, "doc_id BIGINT, raw STRING"))


def test_poisoned_and_clean_documents(spark):
    f = TD.scan_documents(_docs(spark)).collect()
    by = {}
    for r in f:
        by.setdefault(r.doc_id, []).append(r)
    sev = [r.severity for r in by[-101]]
    assert sev.count("critical") >= 3 and "high" in sev
    assert -102 not in by  # clean control
    assert any(r.rule_id == "parse_failed" for r in by[-104])
    assert any(r.rule_id == "db_connection_string" for r in by[-104])
    assert any(r.category == "hidden_unicode" for r in by[-105])
    assert any(r.rule_id == "duplicate_tool_name" for r in by[-106])
    assert any("default" in r.location for r in by[-106] if r.category == "tool_poisoning")


def test_audit_chain_and_anchor(spark):
    from veilscan.operators import audit as AU
    calls = spark.createDataFrame(
        [(1, 0, "t0", "read_file", None, "{}", "ok", [], "L4"), (1, 1, "t1", "http_post", None, "{}", "ok", ["x"], "L1")],
        "session_id BIGINT, index INT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, "
        "outcome STRING, finding_rule_ids ARRAY<STRING>, trust_level STRING")
    stats = spark.createDataFrame([(1, 2, 1, False)], "session_id BIGINT, n_calls BIGINT, n_findings BIGINT, any_critical BOOLEAN")
    log = AU.build_audit_log(AU.record_templates(calls, stats)).checkpoint(eager=True)
    assert log.count() == 4
    v = AU.verify_audit_log(log, "session_id", "n", "record").collect()[0]
    assert v.ok
    edited = log.withColumn("record", F.when(F.col("n") == 1, F.regexp_replace("record", '"ok"', '"no"'))
                            .otherwise(F.col("record")))
    v2 = AU.verify_audit_log(edited, "session_id", "n", "record").collect()[0]
    assert not v2.ok and v2.broken_at == 2
    anchors = AU.compute_anchor(log)
    last = log.withColumn("record", F.when(F.col("n") == 3, F.regexp_replace("record", '"ok"', '"no"'))
                          .otherwise(F.col("record")))
    v3 = AU.verify_audit_log(last, "session_id", "n", "record")
    chk = AU.check_anchor(v3, anchors.select("session_id", "token")).collect()[0]
    assert chk.anchor_ok is False and chk.broken_at is None
