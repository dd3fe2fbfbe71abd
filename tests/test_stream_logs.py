"""Streams over span lines and their state logs give the batch answer, whatever the cut, and stay bounded."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilscan.operators import pins as PN
from veilscan.operators import tooldocs as TD
from veilscan.operators import traces as TR
from veilscan.sources import readers
from veilscan.streaming import jobs
from veilscan.streaming.state import StateTable, distinct_keys, newest_row

LINES = "session_id STRING, line_no BIGINT, line STRING"
FLOW = ["session_id", "event_indexes", "severity", "evidence", "location"]


def span(second, tool, args, otlp=False):
    attributes = {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": tool, "gen_ai.tool.call.arguments": args}
    if otlp:
        attributes = [{"key": k, "value": {"stringValue": v}} for k, v in attributes.items()]
    return json.dumps({"name": "run", "timestamp": f"2030-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "attributes": attributes})


def made_lines(seed=1, sessions=5, n=50):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        session = "hot" if rng.random() < 0.4 else f"s{rng.randrange(sessions)}"
        kind = rng.random()
        if kind < 0.15:
            line = rng.choice(["", "not json", '{"name": "other", "attributes": {}}', "[]"])
        elif kind < 0.4:
            line = span(k, "read_secret_store", "{}", k % 2 == 0)
        else:
            line = span(k, "http_post", f"https://d{rng.randrange(6)}.example.com/x", k % 2 == 1)
        rows.append((session, k, line))
    return rows


def found(df):
    return sorted(tuple(map(str, r)) for r in df.select(*FLOW).collect())


def whole(spark, rows, order="line_no"):
    return found(TR.toxic_flows(TR.event_flags(TR.ingest_spans(spark.createDataFrame(rows, LINES), order_col=order))))


@pytest.mark.parametrize("cut", [[7], [20, 24]])
def test_span_batches_of_any_cut_give_the_batch_answer(spark, tmp_path, cut):
    rows = made_lines()
    expected = whole(spark, rows)
    assert len(expected) > 10
    root, out = str(tmp_path / "state"), str(tmp_path / "out")
    edges = [0, *cut, len(rows)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        part = rows[a:b][::-1]
        for _ in range(2 if k == 1 else 1):  # replayed
            jobs.span_batch(spark.createDataFrame(part, LINES), k, root, out)
    assert found(spark.read.parquet(out)) == expected


def test_span_batches_out_of_order_are_reordered(spark, tmp_path):
    """Lines arrive up to ten seconds late; held calls are numbered by (timestamp, line)."""
    rows = made_lines(2)
    expected = whole(spark, rows)
    rng = random.Random(3)
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 10)
    root, out = str(tmp_path / "state"), str(tmp_path / "out")
    cuts = [0, 18, 35, len(late)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for _ in range(2 if k == 1 else 1):
            jobs.span_batch(spark.createDataFrame(late[a:b], LINES), k, root, out, hold_seconds=11)
    jobs.span_batch(spark.createDataFrame([], LINES), 3, root, out, hold_seconds=11, last=True)
    assert found(spark.read.parquet(out)) == expected


def test_span_stream_reads_files(spark, tmp_path):
    rows = made_lines(4, n=30)
    (tmp_path / "in").mkdir()
    import os
    for k, part in enumerate((rows[:11], rows[11:])):
        path = tmp_path / "in" / f"{k}.json"
        path.write_text("\n".join(json.dumps({"session_id": s, "line_no": n, "line": t}) for s, n, t in part))
        os.utime(path, (1_000_000 + k, 1_000_000 + k))
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = jobs.span_stream(spark, stream, str(tmp_path / "out"))
    query.awaitTermination(300)
    assert found(spark.read.parquet(str(tmp_path / "out"))) == whole(spark, rows)


def test_trace_files_are_sessions(spark, tmp_path):
    rows = made_lines(5, n=40)
    for session in {r[0] for r in rows}:
        (tmp_path / f"{session}.jsonl").write_text("\n".join(t for s, _, t in rows if s == session))
    got = TR.toxic_flows(TR.event_flags(readers.read_traces(spark, str(tmp_path)))).withColumn("session_id", F.regexp_extract("session_id", r"([^/]+)\.jsonl$", 1))
    assert found(got) == whole(spark, rows)


def test_an_earlier_sensitive_call_that_arrives_later_counts_from_then_on(spark, tmp_path):
    schema = "session_id STRING, index BIGINT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, result_text STRING, outcome STRING"
    row = lambda i, tool, args: ("x", i, "t", tool, None, args, "", "ok")
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    for k, rows in enumerate(([row(5, "read_secret_store", "{}")], [row(2, "read_secret_store", "{}")], [row(3, "http_post", "https://a.example.com/")])):
        jobs.taint_batch(spark.createDataFrame(rows, schema), k, state, out)
    assert [r.event_indexes for r in spark.read.parquet(out).collect()] == [[2, 3]]


def test_state_reads_stay_bounded_and_replay(spark, tmp_path):
    """Batch 19 opens no more files than batch 10; what it reads is the state of the batch before."""
    make = lambda: StateTable(spark, str(tmp_path / "s"), "k STRING, v BIGINT", ["k"], newest_row(["k"], ["k", "v"]), buckets=2, fold_every=3)
    table, expected, opened = make(), {}, {}
    for batch in range(20):
        state = {r.k: r.v for r in table.read(batch).collect()} if batch in (1, 10, 19) else None
        assert state is None or state == expected
        opened[batch] = len(table.rows((table.pointers.newest(batch) or {"folders": []})["folders"]).inputFiles())
        delta = [(f"k{batch % 7}", batch), ("hot", batch)] if batch % 5 else []
        for again in range(2 if batch == 9 else 1):
            table.write(batch, spark.createDataFrame(delta, "k STRING, v BIGINT"), {"at": batch})
            if again:
                assert {r.k: r.v for r in make().read(batch).collect()} == expected
        expected.update(delta)
    assert max(opened.values()) <= (3 + 1) * 2 and opened[19] <= max(opened[b] for b in range(11))
    assert len(list((tmp_path / "s" / "commits").glob("0*.json"))) == 2 and len(list((tmp_path / "s" / "data").iterdir())) <= 10
    one = table.read(20, spark.createDataFrame([("hot",), ("none",)], "k STRING")).collect()
    assert [(r.k, r.v) for r in one] == [("hot", 19)] and table.meta(20) == {"at": 19}


def test_distinct_state_keeps_the_first_batch(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "d"), "domain STRING", ["domain"], distinct_keys(["domain"]), fold_every=1)
    for batch, names in enumerate((["a"], ["a", "b"], ["c"], ["a"])):
        table.write(batch, spark.createDataFrame([(n,) for n in names], "domain STRING"))
    assert sorted((r.domain, r.batch_id) for r in table.read(9).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_monitor_batches_take_documents_in_order(spark, tmp_path):
    raw = lambda text: '{"tools": [{"name": "t", "description": "' + text + '"}]}'
    docs = TD.parse_documents(spark.createDataFrame([("p", raw("zz first"), 1), ("p", raw("aa second"), 2)], "config_path STRING, raw STRING, turn INT"))
    jobs.monitor_batch(docs, 0, str(tmp_path / "store"), str(tmp_path / "out"), order_col="turn")
    made = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.rule_id for r in made] == ["description_changed"] and "zz first" in made[0].evidence.split("now:")[0]
    assert [r.description for r in jobs.latest_pins(spark, str(tmp_path / "store"), 1).collect()] == ["aa second"]
    assert PN.collect_tools(docs, carry=["turn"]).columns[:2] == ["config_path", "turn"]


def test_a_session_of_many_sends_gives_one_bounded_record(spark):
    """20,000 sends after one sensitive read: its call lists a rule once, with its count."""
    calls = spark.range(20_001).select(
        F.lit("x").alias("session_id"), F.col("id").alias("index"), F.lit("t").alias("timestamp"),
        F.when(F.col("id") == 0, "read_secret_store").otherwise("http_post").alias("tool_name"), F.lit(None).cast("string").alias("server"),
        F.when(F.col("id") == 0, "{}").otherwise("https://a.example.com/x").alias("arguments_text"), F.lit("").alias("result_text"), F.lit("ok").alias("outcome"))
    made = TR.trust_levels(calls, TR.toxic_flows(TR.event_flags(calls))).where("index = 0").first()
    assert made.finding_rule_ids == ["read_then_exfiltrate"] and [(c.rule_id, c.n) for c in made.finding_counts] == [("read_then_exfiltrate", 20_000)]
    assert made.n_owned == 20_000 and made.trust_level == "L1"


def test_pins_are_read_through_their_pointer(spark, tmp_path):
    """The lock is what was committed last; a version that was written but not committed is not seen."""
    from veilscan.sources.writers import load_pins, save_pins
    root = str(tmp_path / "pins")
    assert load_pins(spark, root) is None
    one = lambda text: spark.createDataFrame([("p", text)], "config_path STRING, description STRING")
    for version in range(8, 12):  # 9 and 10 sort differently as text
        save_pins(one(f"at {version}"), root, version)
    one("lost").write.parquet(f"{root}/version=99")
    assert [r.description for r in load_pins(spark, root).collect()] == ["at 11"]
    assert len(load_pins(spark, root).inputFiles()) <= 8 and [r.description for r in load_pins(spark, root, 9).collect()] == ["at 9"]
    assert len(list((tmp_path / "pins" / "_commits").glob("0*.json"))) == 2
