import json
import os
import tempfile

from pyspark.sql import functions as F


def test_hook_text_and_read_texts(spark):
    from veilscan.sources.readers import read_texts
    d = tempfile.mkdtemp(prefix="vs-hook-")
    with open(os.path.join(d, "p.jsonl"), "w") as fh:
        fh.write(json.dumps({"user_prompt": "hello there"}) + "\n")
        fh.write(json.dumps({"prompt": "first", "text": "second"}) + "\n")
        fh.write(json.dumps({"other": 1}) + "\n")
    rows = [r.text for r in read_texts(spark, d, fmt="text", hook_json=True).collect()]
    assert sorted(rows) == ["first", "hello there"]


def test_read_tool_docs_tolerant(spark):
    from veilscan.sources.readers import read_tool_docs
    d = tempfile.mkdtemp(prefix="vs-docs-")
    with open(os.path.join(d, "a.json"), "w") as fh:
        fh.write('{\n // note\n "tools": [{"name": "x", "description": "y"},],\n}')
    with open(os.path.join(d, "b.json"), "w") as fh:
        fh.write("not json at all")
    rows = {os.path.basename(r.path): r.ok for r in
            read_tool_docs(spark, d).select("path", F.col("doc").isNotNull().alias("ok")).collect()}
    assert rows == {"a.json": True, "b.json": False}


def test_audit_log_write_read_verify(spark):
    from veilscan.operators import audit as AU
    from veilscan.sources.readers import read_audit_log
    from veilscan.sources.writers import write_audit_log
    calls = spark.createDataFrame(
        [(7, 0, "t0", "read_file", None, "{}", "ok", [], "L4"), (7, 1, "t1", "post", None, "{}", "ok", [], "L4")],
        "session_id BIGINT, index INT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, "
        "outcome STRING, finding_rule_ids ARRAY<STRING>, trust_level STRING")
    stats = spark.createDataFrame([(7, 2, 0, False)], "session_id BIGINT, n_calls BIGINT, n_findings BIGINT, any_critical BOOLEAN")
    log = AU.build_audit_log(AU.record_templates(calls, stats))
    out = os.path.join(tempfile.mkdtemp(prefix="vs-log-"), "log")
    write_audit_log(log, out)
    lines = read_audit_log(spark, out)
    v = AU.verify_audit_log(lines, "log_path", "pos", "raw").collect()
    assert len(v) == 1 and v[0].ok and v[0].n_records == 4


def test_state_tables(spark):
    from veilscan.sources.readers import load_string_list
    from veilscan.sources.writers import allow_tokens, load_corpus, load_pins, save_known_destinations, save_pins
    d = tempfile.mkdtemp(prefix="vs-state-")
    p = os.path.join(d, "known.json")
    with open(p, "w") as fh:
        json.dump(["a.example.com", "b.example.com"], fh)
    known = load_string_list(spark, p, "domain")
    assert known.count() == 2
    assert load_string_list(spark, os.path.join(d, "missing.json"), "domain").count() == 0
    seen = spark.createDataFrame([("c.example.com",), ("a.example.com",)], "domain STRING")
    nxt = save_known_destinations(known, seen, os.path.join(d, "known_v2"))
    assert [r.domain for r in nxt.collect()] == ["a.example.com", "b.example.com", "c.example.com"]
    allow = allow_tokens(spark.createDataFrame([], "token_hash STRING"),
                         spark.createDataFrame([("abc",), ("abc",)], "token STRING"))
    assert [r.token_hash for r in allow.collect()] == [
        "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]
    pins = spark.createDataFrame([("c", "(root)/x", "x")], "config_path STRING, key STRING, name STRING")
    save_pins(pins, os.path.join(d, "pins"), 1)
    save_pins(pins.withColumn("name", F.lit("y")), os.path.join(d, "pins"), 2)
    assert load_pins(spark, os.path.join(d, "pins")).first().name == "y"
    assert load_pins(spark, os.path.join(d, "nope")) is None
    corpus = os.path.join(d, "corpus.json")
    with open(corpus, "w") as fh:
        json.dump({"cases": [{"id": "c1", "title": "t", "malicious": True, "expect": {"ruleId": "x"},
                              "doc": {"tools": [{"name": "a"}]}}]}, fh)
    c = load_corpus(spark, corpus).first()
    assert c.id == "c1" and c.malicious and c.expect_rule_id == "x" and json.loads(c.raw) == {"tools": [{"name": "a"}]}


def test_manifest_and_pinned_case(spark):
    from veilscan.operators.report import evaluate_rules
    from veilscan.sources.readers import load_manifest
    d = tempfile.mkdtemp(prefix="vs-man-")
    p = os.path.join(d, "servers.json")
    with open(p, "w") as fh:
        json.dump({"servers": [{"name": "notes", "source": "samples/notes.json", "homepage": "https://x.example"},
                               {"name": "files", "source": "samples/files.json"}]}, fh)
    m = {r.name: (r.source, r.homepage) for r in load_manifest(spark, p).collect()}
    assert m == {"notes": ("samples/notes.json", "https://x.example"), "files": ("samples/files.json", None)}
    cases = spark.createDataFrame([(1, True), (2, False)], "doc_id BIGINT, malicious BOOLEAN")
    static = spark.createDataFrame([(2, "imperative_to_model", 2)], "doc_id BIGINT, rule_id STRING, severity_rank INT")
    drift = spark.createDataFrame([(1, "tool_changed", 4)], "doc_id BIGINT, rule_id STRING, severity_rank INT")
    per_case, summary = evaluate_rules(cases, static, pin_findings=drift)
    res = {r.doc_id: r["pass"] for r in per_case.collect()}
    assert res == {1: True, 2: False}
    s = summary.first()
    assert s.detected == 1 and s.false_positives == 1 and s.recall == 1.0


def test_audit_table_holds_many_sessions_a_file(spark, tmp_path):
    from veilscan.operators import audit as AU
    from veilscan.sources.readers import read_audit_table
    from veilscan.sources.writers import write_audit_table
    records = spark.range(3_000).select((F.col("id") % 1_000).alias("session_id"), F.expr("id DIV 1000").alias("n"))
    records = records.withColumn("record", F.to_json(F.struct("n", "session_id")))
    path = str(tmp_path / "log")
    write_audit_table(records, path, records_per_file=500)
    files = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(files) <= 3_000 // 500 + 2 * spark.sparkContext.defaultParallelism
    some = read_audit_table(spark, path, [7, 8])
    assert sorted((r.log_path, r.pos) for r in some.collect()) == [(s, n) for s in (7, 8) for n in range(3)]
    # records that name no record before them: only the first one of a session can be right
    assert {(r.ok, r.broken_at, r.n_records) for r in AU.verify_audit_log(read_audit_table(spark, path), "log_path", "pos", "raw").collect()} == {(False, 1, 3)}


def test_novelty_spreads_a_hot_domain(spark):
    from veilscan.operators import traces as TR
    calls = spark.range(4_000).select(
        (F.col("id") % 40).alias("session_id"), F.expr("id DIV 40").alias("index"), F.lit("t").alias("timestamp"),
        F.when(F.col("id") < 40, "read_secret_store").otherwise("http_post").alias("tool_name"), F.lit(None).cast("string").alias("server"),
        F.when(F.col("id") < 40, "{}").when(F.col("id") % 3 == 0, "https://hot.example.net/x").otherwise(
            F.concat(F.lit("https://d"), (F.col("id") % 50).cast("string"), F.lit(".example.net/"))).alias("arguments_text"),
        F.lit("").alias("result_text"), F.lit("ok").alias("outcome"))
    known = spark.createDataFrame([(f"d{k}.example.net",) for k in range(25)], "domain STRING")
    got = {(r.session_id, r.event_indexes[1]): r.severity for r in TR.toxic_flows(TR.event_flags(calls), known).collect()}
    want = {(i % 40, i // 40): "critical" if i % 3 == 0 or i % 50 >= 25 else "high" for i in range(40, 4_000)}
    assert got == want


def _spark_rows(spark, path):
    """(path, text) as Spark's own reader gives them."""
    return sorted((r.p, r.value) for r in spark.read.text(path, wholetext=True).select(F.input_file_name().alias("p"), "value").collect())


def test_tool_doc_files_in_few_folders(spark):
    import glob

    import __spark_entry__ as entry
    from conftest import SF_SMALL
    from veilscan.session import checkpoint_dir
    root = os.path.join(checkpoint_dir(spark).removeprefix("file://"), "veilscan-roundtrips", "tool-docs-*")
    before = set(glob.glob(root))
    rows = entry.queries()["tool_doc_files"](spark, SF_SMALL).collect()
    (made,) = set(glob.glob(root)) - before
    found = [(at, names) for at, _, names in os.walk(made)]
    # a file a document, but neither a folder nor a checksum file a document
    assert sum(len(names) for _, names in found) == len(rows) == len({r.doc_id for r in rows}) > 200
    assert len(found) <= 3 * spark.sparkContext.defaultParallelism


def test_tool_docs_written_and_read(spark, tmp_path, monkeypatch):
    from veilscan.sources import readers, writers
    text = {1: '{"a": 1}', 2: "broken {", 3: '{"b": [1,],} // é', -4: "two\nlines", 5: "", 6: None}
    rows = [*text.items(), (1, '{"a": 1}'), (1, '{"a": 2}'), (None, "null")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, raw STRING").repartition(3)
    want = sorted(((i, (t or "") + "\n") for i, t in rows), key=str)
    for at, packed in (("own", False), ("own packed", True), ("other store", False), ("other store, packed", True)):
        at = str(tmp_path / at)
        if "other" in at:  # by Spark's writer and reader
            for module in (writers, readers):
                monkeypatch.setattr(module, "local_folder", lambda spark, path: None)
        writers.write_tool_docs(docs, at, packed=packed)
        made = readers.read_tool_docs(spark, at).select(
            "path", F.regexp_extract("path", r"doc_id=(-?\d+)[./][^/]*$", 1).try_cast("bigint").alias("i"), "raw", F.col("doc").isNotNull().alias("ok")).collect()
        assert sorted(((r.i, r.raw) for r in made), key=str) == want
        assert len({r.path for r in made}) == len(rows)
        assert {r.i: r.ok for r in made} == {1: True, 2: False, 3: True, -4: False, 5: False, 6: False, None: True}
        assert all(r.path.endswith(".gz") == packed for r in made)


def test_read_tool_docs_like_sparks_reader(spark, tmp_path):
    import bz2
    import gzip

    from veilscan.sources.readers import read_tool_docs
    plain, keyed, packed, mixed = (tmp_path / n for n in ("plain docs", "keyed", "packed", "mixed"))
    for d in (plain / "sub", keyed / "k=1" / "m=x y", keyed / "k=2" / "m=_z", keyed / "_k=3", packed, mixed):
        d.mkdir(parents=True)
    for name in ("a.json", "b c.json", "100%.json", "q#?[1].json", "é ü.json", "_hidden.json", ".hidden", "_k=v.json", "x._COPYING_"):
        (plain / name).write_bytes(f'{{"n": "{name}"}}\r\n'.encode())
    (plain / "empty.json").write_bytes(b"")
    (plain / "bad.json").write_bytes(b"\xff\xfe{}")
    (plain / "sub" / "below.json").write_text("{}")
    for n, d in enumerate((keyed / "k=1" / "m=x y", keyed / "k=2" / "m=_z")):
        (d / "doc.json").write_text(f"[{n}]")
    (packed / "a.json.gz").write_bytes(gzip.compress(b'{"z": 1}'))
    (packed / "two.json.gz").write_bytes(gzip.compress(b'{"z"') + gzip.compress(b": 2}"))
    (packed / "none.json.gz").write_bytes(b"")
    (packed / "blank.json.gz").write_bytes(gzip.compress(b""))
    for d in (packed, mixed):
        (d / "b.json").write_text("{}")
    (mixed / "c.json.bz2").write_bytes(bz2.compress(b"[1]"))
    for folder in (plain, keyed, packed, mixed, plain / "a.json", f"{plain}/*.json", f"file://{keyed}/k=*/*"):
        got = read_tool_docs(spark, str(folder))
        assert sorted((r.path, r.raw) for r in got.select("path", "raw").collect()) == _spark_rows(spark, str(folder))
    assert [read_tool_docs(spark, str(d)).where("doc IS NOT NULL").count() for d in (packed, mixed)] == [3, 2]


def test_read_tool_docs_missing_folder(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from veilscan.session import is_missing_path
    from veilscan.sources.readers import read_tool_docs
    with pytest.raises(AnalysisException) as error:
        read_tool_docs(spark, str(tmp_path / "none")).collect()
    assert is_missing_path(error.value)
    (tmp_path / "empty").mkdir()
    assert read_tool_docs(spark, str(tmp_path / "empty")).count() == 0


def _audit_records(spark, sessions, records):
    from veilscan.operators import audit as AU
    kinds = "session_id BIGINT, index BIGINT, timestamp STRING, tool_name STRING, server STRING, arguments_text STRING, outcome STRING, finding_rule_ids ARRAY<STRING>, trust_level STRING"
    calls = spark.createDataFrame([(s, k, f"t{k}", "read", None, f"{s} {k}", "ok", [], "L4") for s in sessions for k in range(records)], kinds)
    stats = spark.createDataFrame([(s, records, 0, False) for s in sessions], "session_id BIGINT, n_calls BIGINT, n_findings BIGINT, any_critical BOOLEAN")
    return AU.build_audit_log(AU.record_templates(calls, stats))


def test_audit_files_leave_one_packed_file_a_session(spark):
    import glob

    import __spark_entry__ as entry
    from conftest import SF_SMALL
    from veilscan.session import checkpoint_dir
    shared = checkpoint_dir(spark).removeprefix("file://")
    root = os.path.join(shared, "veilscan-roundtrips", "audit-*")
    before, kept = set(glob.glob(root)), set(os.listdir(shared))
    rows = entry.queries()["audit_files"](spark, SF_SMALL).collect()
    (made,) = set(glob.glob(root)) - before
    found = [(at, names) for at, _, names in os.walk(made)]
    names = [n for _, names in found for n in names]
    # a file a session, packed, with neither a folder nor a checksum file of its own
    assert sorted(names) == sorted(f"session_id={r.session_id}.jsonl.gz" for r in rows) and len(rows) > 10 and all(r.ok for r in rows)
    assert len(found) <= 2 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what the records were made of is gone; the setting under which shuffle files go is as before
    assert not [n for n in set(os.listdir(shared)) - kept if n.startswith("veilscan-staged")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # the lines are those that Spark's reader finds
    lines = spark.read.text(made, recursiveFileLookup=True)
    assert lines.count() == sum(r.n_records for r in rows) == lines.select(F.get_json_object("value", "$.record_id")).distinct().count()


def test_long_packed_logs_are_read_in_pieces(spark, tmp_path, monkeypatch):
    import pytest

    from veilscan.operators import audit as AU
    from veilscan.sources import readers, writers
    monkeypatch.setattr(writers, "MEMBER", 2_000)
    monkeypatch.setattr(readers, "PIECE", 2_000)
    log = _audit_records(spark, [1, None], 120).unionByName(_audit_records(spark, [2], 1)).localCheckpoint()
    path = str(tmp_path / "logs")
    for whole in (False, True):  # the second run replaces the files of the first
        writers.write_audit_log(log.repartition("session_id").sortWithinPartitions("session_id", "n") if whole else log.repartition(5), path, packed=True, whole=whole)
    folder = readers._folder_files(spark, path)
    pieces = folder.mapInArrow(readers._cut_logs(readers.PIECE), "path string, start long, size long, cut boolean, left boolean").collect()
    count = {os.path.basename(p.path): sum(q.path == p.path for q in pieces) for p in pieces}
    assert set(count) == {f"session_id={s}.jsonl.gz" for s in (1, 2, "__null__")} and count["session_id=1.jsonl.gz"] > 3 and count["session_id=2.jsonl.gz"] == 1
    got = readers.read_audit_log(spark, path).collect()
    want = {(f"session_id={'__null__' if r.session_id is None else r.session_id}.jsonl.gz", r.n, r.record) for r in log.collect()}
    assert {(os.path.basename(r.log_path), r.pos, r.raw) for r in got} == want and len(got) == len(want) == 247
    assert sorted((r.ok, r.n_records) for r in AU.verify_audit_log(readers.read_audit_log(spark, path), "log_path").collect()) == [(True, 3), (True, 122), (True, 122)]
    # a member put behind them by other means is read with the last piece
    (name,) = [p.path for p in pieces if p.path.endswith("=1.jsonl.gz") and p.start == 0]
    import gzip
    with open(name, "ab") as out:
        out.write(gzip.compress(b"not json\n"))
    broken = [r for r in AU.verify_audit_log(readers.read_audit_log(spark, path), "log_path").collect() if not r.ok]
    assert [(r.broken_at, r.reason, r.n_records) for r in broken] == [(122, "record is not valid JSON", 123)]
    # a length that cannot be is not followed; a member that ends within a line is told
    one = writers.gzip_member(os.urandom(4_000).hex().encode() + b"\n")
    (tmp_path / "zero").mkdir()
    (tmp_path / "zero" / "a.gz").write_bytes(one[:16] + bytes(8) + one[24:])
    assert [(r.pos, len(r.raw)) for r in readers.read_audit_log(spark, str(tmp_path / "zero")).collect()] == [(0, 8_000)]
    (tmp_path / "zero" / "b.gz").write_bytes(writers.gzip_member(os.urandom(4_000).hex().encode()) + one)
    with pytest.raises(Exception, match="ends within a line"):
        readers.read_audit_log(spark, str(tmp_path / "zero")).collect()


def test_records_out_of_order_are_not_written_as_whole(spark, tmp_path):
    import pytest

    from veilscan.sources import writers
    rows = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "session_id BIGINT, n BIGINT, record STRING").coalesce(1)
    with pytest.raises(Exception, match="not in chain order"):
        writers.write_audit_log(rows, str(tmp_path / "log"), packed=True, whole=True)


def test_audit_log_reader_like_sparks_reader(spark, tmp_path, monkeypatch):
    import bz2
    import gzip

    from veilscan.sources import readers
    texts = {"a b.jsonl": b"\xef\xbb\xbfone\r\ntwo\rthree\n\n \t\x0b\x0c\n\xc3\xa9\xff last", "b%.jsonl": b"", "c.jsonl": b"\r\n\nx\r", "_no.jsonl": b"hidden",
             "d.jsonl.gz": gzip.compress(b"one\ntw") + gzip.compress(b"o\nthree"), "e.jsonl.gz": b"", "long.jsonl": b"".join(b"%d\r\n" % k for k in range(400_000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)

    def rows(df):
        return sorted((r.log_path, r.pos, r.h) for r in df.select("log_path", "pos", F.hex("raw").alias("h")).where("pos < 100 OR pos % 1000 = 999").collect())

    own = rows(readers.read_audit_log(spark, str(tmp_path)))
    with monkeypatch.context() as m:
        m.setattr(readers, "_folder_files", lambda *_: None)
        assert own == rows(readers.read_audit_log(spark, str(tmp_path)))
    assert len(own) > 500
    with monkeypatch.context() as m:  # a long plain file is left to Spark's reader, which cuts it
        m.setattr(readers, "PIECE", 1_000_000)
        assert readers._folder_lines(spark, str(tmp_path)) is None
        assert own == rows(readers.read_audit_log(spark, str(tmp_path)))
    (tmp_path / "g.jsonl.bz2").write_bytes(bz2.compress(b"{}"))
    assert readers._folder_lines(spark, str(tmp_path)) is None


def test_audit_runs_judge_like_pairs_of_lines(spark):
    import random

    from veilscan.operators import audit as AU
    log = [(r.session_id, r.n, r.record) for r in _audit_records(spark, [0], 8).collect()]
    rng, rows = random.Random(7), []
    for s in range(120):
        mine = [(s, n + s % 3, text) for _, n, text in sorted(log, key=lambda r: r[1])]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k, what = rng.randrange(len(mine)), rng.choice(["edit", "drop", "json", "again", "other", "first", "shift"])
            _, n, text = mine[k]
            if what == "edit":
                mine[k] = (s, n, text.replace('"ok"', '"no"'))
            elif what == "drop":
                mine.pop(k)
            elif what == "json":
                mine[k] = (s, n, "{")
            elif what == "again":
                mine.append(mine[k])
            elif what == "other":
                mine.append((s, n, text.replace('"ok"', '"no"')))
            elif what == "first":
                mine[k] = (s, n, text.split('"prev_hash":')[0] + '"prev_hash":null}')
            else:
                mine = [(s, m + (m > n), t) for _, m, t in mine]
        rows += mine
    rng.shuffle(rows)
    rows += [(None, n, text.replace("read", "other") if n == 4 else text) for _, n, text in log]
    lines = spark.createDataFrame(rows, "session_id BIGINT, pos BIGINT, raw STRING")
    want = {tuple(r) for r in AU._verify_pairs(lines).collect()}
    assert 30 < sum(w[1] for w in want) < 90 and (None, False, 5) in {w[:3] for w in want}
    # lines that lie together, spread by session, and each anywhere
    for spread in (lines.coalesce(1), lines.repartition(4, "session_id"), lines.repartition(7)):
        got = AU.verify_audit_log(spread).collect()
        assert len(got) == len(want) == 121 and {tuple(r) for r in got} == want


def test_numbers_within_keys_over_partitions(spark):
    from pyspark.sql import Window

    from veilscan.operators import traces as TR
    # one key holds nearly all rows and others stand around it; a null key is a key
    rows = spark.range(6_000).select(
        F.when(F.col("id") % 10 < 8, 5).when(F.col("id") % 100 == 8, F.lit(None)).otherwise(F.col("id") % 13).cast("long").alias("k"),
        F.timestamp_micros(F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("ts"), "id")
    got = TR.sequence_within(rows, "k", ["ts", "id"], partitions=9)
    assert got.columns == ["k", "ts", "id", "index"]
    want = rows.withColumn("index", F.row_number().over(Window.partitionBy("k").orderBy("ts", "id")).cast("long") - 1)
    assert got.count() == 6_000 and got.exceptAll(want).count() == 0
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()  # the rows move once
    assert TR.sequence_within(rows.where("k < 0"), "k", ["ts", "id"]).count() == 0


def test_audit_files_in_a_store_that_only_spark_opens(spark, monkeypatch):
    import __spark_entry__ as entry
    from conftest import SF_SMALL
    from veilscan.sources import readers, writers
    own = sorted(map(tuple, entry.queries()["audit_files"](spark, SF_SMALL).collect()))
    for module in (writers, readers):
        monkeypatch.setattr(module, "local_folder", lambda spark, path: None)
    assert sorted(map(tuple, entry.queries()["audit_files"](spark, SF_SMALL).collect())) == own and len(own) > 10
