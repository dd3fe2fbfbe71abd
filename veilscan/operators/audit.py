"""Hash-chained audit logs: build, verify, anchor, per-session export.

Building: every record's canonical JSON (sorted keys, compact) is produced by
Spark in parallel, as the texts before and after ``prev_hash``, from the fields
that were shuffled. Only the chain itself is sequential: record n's hash covers record n-1's hash. That fold runs
in ``mapInArrow`` over partitions hashed by session and sorted by record
number, streaming Arrow batches with O(1) state per session (a running
SHA-256 for the closing summary), so a session of any length never has to fit
in memory. Sessions are independent, so the fold parallelises across them; a
single hot session is inherently one sequential chain.

Verifying needs no fold of a session: each line's hash is recomputed
independently. Lines that lie in order in one task are compared there and become
one row a run; only the ends of runs meet the next run's ``prev_hash`` in an
equi-join on (session, position + 1), which spreads evenly even for one huge
session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.session import materialize

RECORDER_TOOL = "veilscan-recorder"
ANCHOR_PREFIX = "vs-anchor:v1"
ARTICLE12_NOTE = "Local export. Retain per Article 19/26 (minimum 6 months)."


def _canonical(struct_col: Column) -> Column:
    """Compact JSON (nulls kept) of a struct; its fields are named in the order of their keys, so that it is sorted."""
    return F.to_json(struct_col, {"ignoreNullFields": "false"})


def _inside(struct_col: Column) -> Column:
    """Canonical JSON of a struct without its braces."""
    text = _canonical(struct_col)
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _record_id(n: Column) -> Column:
    return F.concat(F.col("session_id").cast("string"), F.lit("-"), n.cast("string"))


#: Fields of records besides session_id, n and action_type; a record has those of its type.
_FIELDS = {"agent_id": "string", "agent_version": "string", "outcome": "string", "timestamp": "string", "trust_level": "string",
           "finding_rule_ids": "array<string>", "parameters_hash": "binary", "tool_name": "string", "server": "string", "n_findings": "long"}


def record_templates(calls: DataFrame, session_stats: DataFrame, agent_id: str = "agent",
                     agent_version: str = "0") -> DataFrame:
    """The fields of each record of a log but its hashes: (session_id, n, action_type, ``_FIELDS``).

    The records' texts are made of them behind the shuffle of ``build_audit_log``:
    what moves is short, with the bytes of a hash in place of the arguments.

    ``calls``: session_id, index, timestamp, tool_name, server, arguments_text,
    outcome, finding_rule_ids, trust_level (see ``traces.trust_levels``).
    ``session_stats``: session_id, n_calls, n_findings, any_critical.
    """
    def rows(df: DataFrame, action_type: str, n: Column, **fields) -> DataFrame:
        fields |= {"agent_id": F.lit(agent_id), "agent_version": F.lit(agent_version)}
        return df.select("session_id", n.cast("long").alias("n"), F.lit(action_type).alias("action_type"),
                         *[fields.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS.items()])

    start = rows(session_stats, "session_start", F.lit(0), outcome=F.lit("ok"), timestamp=F.lit("(session start)"), trust_level=F.lit("L4"))
    mid = rows(calls, "tool_call", F.col("index") + 1, parameters_hash=F.unhex(F.sha2(F.col("arguments_text"), 256)),
               **{name: F.col(name) for name in ("outcome", "timestamp", "trust_level", "finding_rule_ids", "tool_name", "server")})
    close = rows(session_stats, "session_close", F.col("n_calls") + 1, outcome=F.lit("ok"), timestamp=F.lit("(session close)"),
                 trust_level=F.when(F.col("any_critical"), F.lit("L0")).otherwise(F.lit("L4")), n_findings=F.col("n_findings"))
    return start.unionByName(mid).unionByName(close)


def _record_texts(templates: DataFrame) -> DataFrame:
    """Canonical records around their hashes: (session_id, n, head, after_session, tail).

    A record is ``head + prev_hash + tail``; the closing one is
    ``head + session_hash + after_session + prev_hash + tail``. The hashes are
    put between columns, never searched for, so no text of a trace can stand in
    their way.
    """
    n, kind = F.col("n"), F.col("action_type")
    # the fields that sort between ``action_detail`` and ``prev_hash``, and the latter's name
    between = F.struct("action_type", "agent_id", "agent_version", "outcome",
                       F.when(n > 0, _record_id(n - 1)).alias("parent_record_id"))
    between = F.concat(F.lit(","), _inside(between), F.lit(',"prev_hash":'))
    call = F.struct("finding_rule_ids", (F.size("finding_rule_ids") > 0).alias("flagged"),
                    F.concat(F.lit("sha256:"), F.lower(F.hex("parameters_hash"))).alias("parameters_hash"),
                    "tool_name", F.col("server").alias("tool_server"))
    detail = F.when(kind == "tool_call", _canonical(call)).otherwise(_canonical(F.struct(F.lit(RECORDER_TOOL).alias("tool"))))
    counts = F.struct(F.col("n_findings").alias("findings"), n.alias("records"))
    closes = kind == "session_close"
    # the fields that sort after ``prev_hash``, to the end of the record
    tail = F.struct(_record_id(n).alias("record_id"), F.col("session_id").cast("string").alias("session_id"), "timestamp", "trust_level")
    return templates.select(
        "session_id", "n",
        F.when(closes, F.concat(F.lit('{"action_detail":{'), _inside(counts), F.lit(',"session_hash":')))
         .otherwise(F.concat(F.lit('{"action_detail":'), detail, between)).alias("head"),
        F.when(closes, F.concat(F.lit("}"), between)).alias("after_session"),
        F.concat(F.lit(","), _inside(tail), F.lit("}")).alias("tail"))


def _make_fold():
    """The sequential hash fold over (session_id, n)-sorted rows of one partition.

    Built as a closure so it is shipped to the Python workers by value: the
    workers need only hashlib and pyarrow, not this package.
    """
    def fold(batches):
        import hashlib as _hl
        import pyarrow as _pa
        cur, prev, summary, count = None, None, None, 0
        for b in batches:
            lines, hashes = [], []
            for sid, head, after, tail in zip(*(b.column(c).to_pylist() for c in ("session_id", "head", "after_session", "tail"))):
                if summary is None or sid != cur:
                    cur, prev, summary, count = sid, None, _hl.sha256(), 0
                if after is not None:   # closing summary: all hashes + record count
                    s = summary.copy()
                    s.update(str(count).encode("utf-8"))
                    head = f'{head}"sha256:{s.hexdigest()}"{after}'
                line = head + ("null" if prev is None else f'"{prev}"') + tail
                h = "sha256:" + _hl.sha256(line.encode("utf-8")).hexdigest()
                summary.update(h.encode("utf-8"))
                count += 1
                lines.append(line)
                hashes.append(h)
                prev = h
            yield _pa.RecordBatch.from_arrays([b.column("session_id"), b.column("n"), _pa.array(lines, _pa.string()), _pa.array(hashes, _pa.string())],
                                              names=["session_id", "n", "record", "hash"])
    return fold


def build_audit_log(templates: DataFrame) -> DataFrame:
    """(session_id, n, record JSON line, hash) of ``record_templates`` with the hash chain filled in; a task holds whole sessions in chain order."""
    sid_type = dict(templates.dtypes)["session_id"]
    ordered = templates.repartition("session_id").sortWithinPartitions("session_id", "n")
    return _record_texts(ordered).mapInArrow(_make_fold(), f"session_id {sid_type}, n long, record string, hash string")


def record_hash(raw: Column) -> Column:
    """sha256 of the canonical form of a JSON record, without its ``signature``."""
    return _record_hash(F.try_parse_json(raw))


def _record_hash(v: Column) -> Column:
    whole = F.to_json(v)
    m = F.try_variant_get(v, "$", "map<string,variant>")
    # the fields are looked up only where the text has the key somewhere
    has_sig = (F.instr(whole, '"signature":') > 0) & F.map_contains_key(F.coalesce(m, F.create_map().cast("map<string,variant>")), "signature")
    stripped = F.to_json(F.parse_json(F.to_json(F.map_filter(m, lambda k, _v: k != "signature"))))
    canon = F.when(has_sig, stripped).otherwise(whole)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.concat(F.lit("sha256:"), F.sha2(canon, 256)))


def _make_runs():
    """Lines in (session_id, pos) order of one partition -> a row for each run of successive positions.

    ``bad`` is the first position in a run whose record is no JSON or does not
    name the record before it; the run's first record is judged with the run before.
    """
    def runs(batches):
        import pyarrow as _pa
        names = ["session_id", "first", "last", "n", "opens", "valid", "bad", "bad_json", "head"]

        def send():
            return _pa.RecordBatch.from_arrays([_pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

        done, run, kinds = [], None, None
        for b in batches:
            kinds = [b.schema.field("session_id").type, _pa.int64(), _pa.int64(), _pa.int64(), _pa.string(), _pa.bool_(), _pa.int64(), _pa.bool_(), _pa.string()]
            for sid, pos, h, prev in zip(*(b.column(c).to_pylist() for c in ("session_id", "pos", "h", "prev_field"))):
                if run is not None and pos == run[2] + 1 and sid == run[0]:
                    if run[6] is None and (h is None or run[8] is None or prev != run[8]):
                        run[6:8] = pos, h is None
                    run[2], run[3], run[8] = pos, run[3] + 1, h
                else:
                    if run is not None:
                        done.append(run)
                    run = [sid, pos, pos, 1, prev, h is not None, None, None, h]
            if len(done) > 10_000:
                yield send()
                done = []
        if run is not None:
            done.append(run)
            yield send()
    return runs


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which a null one equals a null one."""
    # the names stay with the columns, so they are none that a caller has
    joined = left.alias("_left").join(right.alias("_right"), [F.col(f"_left.{k}").eqNullSafe(F.col(f"_right.{k}")) for k in keys], how)
    return joined if how == "left_semi" else joined.select("_left.*", *[F.col(f"_right.{c}") for c in right.columns if c not in keys])


_MISMATCH = "prev_hash mismatch (a record was inserted, removed, or edited at or before line "


def _reason(bad_json: Column, at: Column) -> Column:
    return F.when(bad_json, F.lit("record is not valid JSON")).otherwise(F.concat(F.lit(_MISMATCH), at.cast("string"), F.lit(")")))


def verify_audit_log(lines: DataFrame, session_col: str = "session_id", pos_col: str = "pos",
                     raw_col: str = "raw") -> DataFrame:
    """Per session: ok, broken_at (first bad position), reason, n_records, head_hash."""
    raw = lines.select(F.col(session_col).alias("session_id"), F.col(pos_col).cast("long").alias("pos"), F.col(raw_col).alias("raw"))
    r = raw.select("session_id", "pos", F.try_parse_json("raw").alias("_v"))
    # each record is parsed and hashed once: the links, the previous hashes and the totals all read the runs of these rows
    r = r.select("session_id", "pos", _record_hash(F.col("_v")).alias("h"), F.try_variant_get("_v", "$.prev_hash", "string").alias("prev_field"))
    kind = dict(r.dtypes)["session_id"]
    runs = materialize(r.sortWithinPartitions("session_id", "pos").mapInArrow(
        _make_runs(), f"session_id {kind}, first long, last long, n long, opens string, valid boolean, bad long, bad_json boolean, head string"))
    total = runs.groupBy("session_id").agg(F.min("first").alias("p0"), F.max("last").alias("p1"), F.sum("n").alias("n_records"),
                                           F.max_by("head", "last").alias("head_hash"))
    ends = runs.select("session_id", (F.col("last") + 1).alias("first"), F.col("head").alias("expected"), F.lit(True).alias("follows"))
    j = _joined(_joined(runs, ends, ["session_id", "first"], "left"), total.select("session_id", "p0"), ["session_id"], "inner")
    linked = F.coalesce(F.col("opens") == F.col("expected"),
                        F.col("opens").isNull() & F.col("expected").isNull() & (F.col("first") == F.col("p0")), F.lit(False))
    wrong = ~F.col("valid") | ~linked
    found = F.struct(F.when(wrong, F.col("first")).otherwise(F.col("bad")).alias("pos"),
                     F.when(wrong, ~F.col("valid")).otherwise(F.col("bad_json")).alias("json"))
    breaks = j.groupBy("session_id").agg(F.min(F.when(wrong | F.col("bad").isNotNull(), found)).alias("b"),
                                         F.count_if(F.col("follows").isNull() & (F.col("first") != F.col("p0"))).alias("gaps"))
    out = _joined(total, breaks, ["session_id"], "left")
    # each run follows another one and all positions count once: then no position is held twice
    odd = (F.col("gaps") > 0) | (F.col("n_records") != F.col("p1") - F.col("p0") + 1)
    at = F.col("b.pos") - F.col("p0")
    checked = out.select("session_id", F.col("b").isNull().alias("ok"), at.alias("broken_at"),
                         F.when(F.col("b").isNotNull(), _reason(F.col("b.json"), at)).alias("reason"), "n_records", "head_hash", odd.alias("_odd"))
    again = checked.where("_odd").select("session_id")
    if again.isEmpty():
        return checked.drop("_odd")
    return checked.where("NOT _odd").drop("_odd").unionByName(_verify_pairs(_joined(raw, again, ["session_id"], "left_semi")))


def _verify_pairs(raw: DataFrame) -> DataFrame:
    """``verify_audit_log`` of sessions with missing or repeated positions: each line meets all lines at the position before."""
    r = raw.select("session_id", "pos", F.try_parse_json("raw").alias("_v"))
    r = materialize(r.select("session_id", "pos", _record_hash(F.col("_v")).alias("h"),
                             F.try_variant_get("_v", "$.prev_hash", "string").alias("prev_field")))
    prev = r.select("session_id", (F.col("pos") + 1).alias("pos"), F.col("h").alias("expected_prev"))
    first_pos = r.groupBy("session_id").agg(F.min("pos").alias("p0"), F.count(F.lit(1)).alias("n_records"),
                                            F.max(F.struct("pos", "h"))["h"].alias("head_hash"))
    j = _joined(_joined(r, prev, ["session_id", "pos"], "left"), first_pos.select("session_id", "p0"), ["session_id"], "inner")
    bad_json, at = F.col("h").isNull(), F.col("pos") - F.col("p0")
    chain_bad = ~F.coalesce(F.col("prev_field") == F.col("expected_prev"),
                            F.col("prev_field").isNull() & F.col("expected_prev").isNull() & (F.col("pos") == F.col("p0")),
                            F.lit(False))
    breaks = (j.where(bad_json | chain_bad).groupBy("session_id")
              .agg(F.min(F.struct(at.alias("at"), _reason(bad_json, at).alias("reason"))).alias("b")))
    out = _joined(first_pos, breaks, ["session_id"], "left")
    return out.select("session_id", F.col("b").isNull().alias("ok"), F.col("b.at").alias("broken_at"),
                      F.col("b.reason").alias("reason"), "n_records", "head_hash")


def compute_anchor(log: DataFrame, session_col: str = "session_id", pos_col: str = "n",
                   hash_col: str = "hash", record_col: str = "record") -> DataFrame:
    """Per session: head hash, record count, fingerprint of record 0, token."""
    a = log.groupBy(session_col).agg(
        F.max_by(hash_col, pos_col).alias("head_hash"), F.count(F.lit(1)).alias("record_count"),
        F.min_by(F.try_variant_get(F.try_parse_json(record_col), "$.action_detail.public_key_fingerprint", "string"),
                 pos_col).alias("fingerprint"))
    token = F.concat_ws(":", F.lit(ANCHOR_PREFIX), F.col("record_count").cast("string"),
                        F.coalesce("fingerprint", F.lit("nosig")), F.coalesce("head_hash", F.lit("(empty)")))
    return a.withColumn("token", token)


def parse_anchor(token: Column) -> Column:
    p = r"^vs-anchor:v1:(\d+):([^:]+):(.+)$"
    t = F.trim(token)
    ok = t.rlike(p)
    return F.when(ok, F.struct(F.regexp_extract(t, p, 1).cast("long").alias("record_count"),
                               F.regexp_extract(t, p, 2).alias("fingerprint"),
                               F.regexp_extract(t, p, 3).alias("head_hash")))


def check_anchor(verified: DataFrame, anchors: DataFrame) -> DataFrame:
    """Join verification results with recorded anchors; the anchor catches edits of the last record."""
    a = anchors.select("session_id", parse_anchor(F.col("token")).alias("a"))
    j = verified.join(a, "session_id", "left")
    match = (F.col("a.record_count") == F.col("n_records")) & (F.col("a.head_hash") == F.col("head_hash"))
    return j.withColumn("anchor_ok", F.when(F.col("a").isNull(), F.lit(None)).otherwise(match)) \
            .withColumn("ok", F.col("ok") & F.coalesce(F.col("anchor_ok"), F.lit(True))).drop("a")


def export_article12(events: DataFrame, flagged: DataFrame, findings_per_session: DataFrame,
                     agent_id: str = "agent", agent_version: str = "0") -> tuple[DataFrame, DataFrame]:
    """Record-keeping export as (header, entries).

    header: one row per session with totals; entries: one JSON line per call
    with its flagged rule ids. Written partitioned by session they form the
    per-session document without ever collecting a session into one value.
    """
    e = events.join(flagged.select("session_id", "index", "finding_rule_ids"), ["session_id", "index"], "left")
    entry = F.to_json(F.struct(
        F.col("index").alias("index"), F.col("timestamp").alias("timestamp"), F.col("tool_name").alias("tool_name"),
        F.col("server").alias("tool_server"), F.col("outcome").alias("outcome"),
        F.coalesce("finding_rule_ids", F.array().cast("array<string>")).alias("flagged_rule_ids")),
        {"ignoreNullFields": "false"})
    entries = e.select("session_id", "index", entry.alias("entry"))
    head = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_tool_calls"))
    head = head.join(findings_per_session, "session_id", "left").withColumn(
        "total_findings", F.coalesce("total_findings", F.lit(0)))
    header = head.select(
        "session_id", F.lit("EU AI Act Article 12 (record-keeping), operation-level event log").alias("standard"),
        F.lit(ARTICLE12_NOTE).alias("note"),
        F.lit(agent_id).alias("agent_id"), F.lit(agent_version).alias("agent_version"),
        "total_tool_calls", "total_findings")
    return header, entries
