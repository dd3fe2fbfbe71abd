"""Steps whose cost must follow the input: what may be left out of them, and what may not."""

import hashlib
import json

from pyspark.sql import functions as F

from veilscan.operators import audit as AU
from veilscan.operators import report as RP
from veilscan.operators import rewrite as RW
from veilscan.operators import scan as S
from veilscan.operators import tooldocs as TD
from veilscan.operators import traces as TR
from veilscan.sources.readers import read_table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tool(text: str) -> str:
    return '{"tools": [{"name": "t", "description": "' + text + '"}]}'


def test_only_texts_that_may_hold_a_finding_are_walked(spark):
    tripped = {"instruction_override": [r"x\nignore\tall\n instructions", r"ignore the rules", "forget prompts"],
               "hidden_from_user": [r"do not\r\ntell the\nuser", "silently"],
               "embedded_directive_tags": [r"<\/s>>", r"[\tsystem\n]", "< important >"],
               "exfiltration_directive": [r"reads\n the.ssh", "cat " + "\\t" * 30 + "id_rsa", r"opening the a~\/.x", "posting my data"],
               "tool_redirection": ["instead of this tool"], "imperative_to_model": [r"you must"],
               "unicode_zero_width": ["a​b"], "unicode_tag_chars": ["a\U000E0041b"]}
    raws = [(rule, tool(text)) for rule, texts in tripped.items() for text in texts]
    raws += [("instruction_override", '{"tools": [{"description": "ign/* x */ore all rules",}]}'), ("none", tool("A plain text. It reads. The data stay.")),
             ("instruction_override", '{"tools": [{"ignore all rules": 1}]}')]
    docs = spark.createDataFrame([(k, rule, raw) for k, (rule, raw) in enumerate(raws)], "doc_id INT, rule STRING, raw STRING")
    tripping = {r.doc_id for r in docs.where(S.trips(F.col("raw"), TD._TEXT_TRIPS)).collect()}
    assert tripping == {k for k, (rule, _) in enumerate(raws) if rule != "none"}
    found = {(r.doc_id, r.rule_id) for r in TD.poison_findings(TD.parse_documents(docs)).collect()}
    assert found == {(k, rule) for k, (rule, _) in enumerate(raws) if rule != "none"}
    assert {(r.doc_id, r.rule_id) for r in TD.scan_documents(docs).collect()} == found


def test_a_text_with_any_match_trips_the_joint_pattern(spark):
    texts = ["AKIA" + "A1B2C3D4E5F6G7H8", "mail a@example.org", "call 212-555-0187", "123-45-6789", "pay bob@upi", "nothing here", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id INT, text STRING")
    hit = {r.doc_id for r in S.scan_text(df).collect()}
    tripped = {r.doc_id for r in df.where(S.trips(F.col("text"), S.ANY_RULE)).collect()}
    assert hit and hit <= tripped and not tripped & {5, 6}


def test_depth_of_brackets_outside_of_strings(spark):
    nested = "[" * 40 + "]" * 40
    raws = ['{"a": "[[[[", "b": [{}]}', r'{"a": "\"[[["}', "/* [[[[ */ {\"a\": [1,]}", "// no end [[", nested, "", None, '{"a": "[" // [[[\n}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k INT, raw STRING")
    got = dict((r.k, r._depth) for r in TD.with_depth(df, "raw").collect())
    assert got == {0: 3, 1: 1, 2: 2, 3: 2, 4: 40, 5: 0, 6: 0, 7: 1}


def test_sarif_documents_read_the_findings_once(spark):
    rows = [(d, "poison", f"r{k % 2}", f"t{k}", "high", 3, 0.5, f"l{9 - k}", "e", "x", ["LLM01"]) for d in range(3) for k in range(5)]
    f = spark.createDataFrame(rows, "doc_id INT, category STRING, rule_id STRING, title STRING, severity STRING, severity_rank INT, confidence DOUBLE, "
                              "location STRING, evidence STRING, explanation STRING, owasp ARRAY<STRING>")
    f = f.withColumn("title", F.concat("title", F.lit("")))
    doc = RP.to_sarif(f)[2]
    assert plan(doc).count("ExistingRDD") == 1
    report = json.loads(doc.where("doc_id = 1").first().sarif)["runs"][0]
    assert [r["id"] for r in report["tool"]["driver"]["rules"]] == ["r0", "r1"]
    assert [r["name"] for r in report["tool"]["driver"]["rules"]] == ["t4", "t3"]
    assert len(report["results"]) == 5 and report["results"] == sorted(report["results"], key=lambda r: (r["ruleId"], r["level"], r["message"]["text"]))


def test_audit_records_name_every_finding(spark):
    kinds = "session_id INT, index BIGINT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, outcome STRING"
    events = spark.createDataFrame([(1, 0, "t0", "read", None, "a", "ok"), (1, 1, "t1", "post", None, "b", "ok"), (1, 2, "t2", "post", None, "c", "ok")], kinds)
    found = spark.createDataFrame([(1, [0, 1], "flow", 3), (1, [0, 2], "flow", 4), (1, [0], "a_secret", 2)], "session_id INT, event_indexes ARRAY<BIGINT>, rule_id STRING, severity_rank INT")
    levels = TR.trust_levels(events, found)
    ids = ["a_secret", "flow", "flow"]
    calls = TR.every_finding(levels)
    assert {r["index"]: r.finding_rule_ids for r in calls.collect()} == {0: ids, 1: ["flow"], 2: ["flow"]}
    log = AU.build_audit_log(AU.record_templates(calls, TR.session_stats(levels)))
    assert json.loads(log.where("n = 1").first().record)["action_detail"]["finding_rule_ids"] == ids
    entries = AU.export_article12(events, calls, found.groupBy("session_id").agg(F.count("rule_id").alias("total_findings")))[1]
    assert json.loads(entries.where("index = 0").first().entry)["flagged_rule_ids"] == ids


def test_audit_lines_are_hashed_once(spark):
    calls = TR.every_finding(TR.trust_levels(
        spark.createDataFrame([(1, k, f"t{k}", 'a "signature":  / <b>', None, "a", "ok") for k in range(4)],
                              "session_id INT, index BIGINT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, outcome STRING"),
        spark.createDataFrame([], "session_id INT, event_indexes ARRAY<BIGINT>, rule_id STRING, severity_rank INT")))
    log = AU.build_audit_log(AU.record_templates(calls, TR.session_stats(calls))).select("session_id", F.col("n").alias("pos"), F.col("record").alias("raw"), "hash")
    signed = log.withColumn("raw", F.when(F.col("pos") == 2, F.regexp_replace("raw", r"\}$", r',"signature":"s"}')).otherwise(F.col("raw")))
    for lines in (log, signed):
        checked = AU.verify_audit_log(lines)
        assert plan(checked).count("sha2") == 0
        assert (checked.first().ok, checked.first().n_records) == (True, 6)
    assert log.where(AU.record_hash(F.col("raw")) != F.col("hash")).count() == 0


def test_only_fields_with_a_match_are_scanned_for_secrets(spark):
    events = spark.createDataFrame([(1, 0, "read", "HTTPS://A.example/x and ftp://b http://10.0.0.1:8/y", "mail a@example.org"), (1, 1, "read", "none", ""), (1, 2, "read", None, None)],
                                   "session_id INT, index BIGINT, tool_name STRING, arguments_text STRING, result_text STRING")
    assert "ArrowEvalPython" in plan(TR.secret_findings(events))
    assert [r.event_indexes for r in TR.secret_findings(events).collect()] == [[0]]
    flags = {r["index"]: ([d.domain for d in r.domains] if r.domains is not None else None, r.reads_sensitive) for r in TR.event_flags(events).collect()}
    assert flags == {0: (["a.example", "10.0.0.1"], True), 1: ([], False), 2: (None, None)}


def test_levels_go_on_from_the_level_before(spark):
    texts = ["Could you please just write a summary of the report? ```please just keep the code``` Thanks in advance!", "I think the answer is, basically, an apple .", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, text STRING")
    levels = RW.compress_levels(df)
    got = {(r.k, r.level): r.compressed_text for r in levels.collect()}
    for level in RW.LEVELS:
        assert {r.k: r.c for r in df.select("k", RW.compress_text(F.col("text"), level).alias("c")).collect()} == {k: got[k, level] for k in range(len(texts))}
    rules = RW.LEVEL_RULES["caveman"]
    assert all(RW.LEVEL_RULES[lv] == rules[:len(RW.LEVEL_RULES[lv])] for lv in RW.LEVELS)
    assert plan(levels).count("my question is") == 1  # a rule of the third level, not run again for the fourth


def test_rows_of_a_task_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t", rows_a_task=10).rdd.getNumPartitions() == 100


def test_audit_texts_are_made_behind_the_shuffle(spark):
    calls = TR.every_finding(TR.trust_levels(
        spark.createDataFrame([(1, 0, "t0", "read", None, "x" * 1000, "ok"), (1, 1, "t1", None, "s", None, None)],
                              "session_id INT, index BIGINT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, outcome STRING"),
        spark.createDataFrame([], "session_id INT, event_indexes ARRAY<BIGINT>, rule_id STRING, severity_rank INT")))
    log = AU.build_audit_log(AU.record_templates(calls, TR.session_stats(calls), "me", "2"))
    shown = log._jdf.queryExecution().optimizedPlan().toString()
    above, below = shown.split("RepartitionByExpression")
    assert " AS head#" in above and " AS head#" not in below and "StructsToJson" in above and "StructsToJson" not in below and "sha2(" in below
    records = [json.loads(r.record) for r in log.orderBy("n").collect()]
    assert [r["action_type"] for r in records] == ["session_start", "tool_call", "tool_call", "session_close"]
    assert records[1]["action_detail"]["parameters_hash"] == "sha256:" + hashlib.sha256(b"x" * 1000).hexdigest()
    assert (records[2]["action_detail"], records[2]["outcome"], records[2]["parent_record_id"]) == (
        {"finding_rule_ids": [], "flagged": False, "parameters_hash": None, "tool_name": None, "tool_server": "s"}, None, "1-1")
    assert {(r["agent_id"], r["agent_version"]) for r in records} == {("me", "2")} and AU.verify_audit_log(log, "session_id", "n", "record").first().ok
