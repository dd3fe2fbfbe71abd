"""Secret / PII scanning of text columns and the projections built on findings.

Design: every rule becomes two regex passes over the text column inside one
projection (matches + gaps, see ``matches_with_offsets``), guarded by a cheap
literal / regex prefilter. The per-row result is an array of hits; validators
filter it in place. From that array we either ``explode`` (findings table) or
rebuild the text (redaction, marking) in the same row pass, so scanning and
redacting a table needs **no shuffle**: the job is a map-only scan that scales
linearly with executors.
"""

from __future__ import annotations

import re
from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import bind_sql, blocks_sql, matches_with_offsets, offsets_sql, q_ident, raw_matches, sql_str, to_java, to_re2
from veilscan.functions.rules import ALL_RULES, RULE_ORD, SEVERITY_RANK, Rule
from veilscan.functions.validators import card_ok, card_ok_sql, verhoeff_ok, verhoeff_ok_sql
from veilscan.session import ship_package

HIT_TYPE = "array<struct<rule_ord:int,s:int,e:int,m:string>>"
HIT_STRUCT = HIT_TYPE[len("array<"):-1]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _guard(text: Column, rule: Rule) -> Column | None:
    if rule.literals:
        cond = None
        for lit in rule.literals:
            c = F.instr(text, lit) > 0
            cond = c if cond is None else (cond | c)
        return cond
    if rule.guard:
        return text.rlike(rule.guard)
    return None


def any_pattern(rules: Sequence[Rule]) -> str:
    """RE2 pattern that every text with a match of any rule matches (lookarounds, which RE2 lacks, are left out)."""
    return "|".join(f"(?:{re.sub(r'[(][?]<?[!=][^()]*[)]', '', to_re2(r.pattern, r.ignore_case))})" for r in rules)


ANY_RULE = any_pattern(ALL_RULES)


def trips(text: Column, pattern: str, pinned: bool = False) -> Column:
    """Boolean: RE2 (Arrow's regex engine, one pass, linear in the text) finds the pattern; NULL texts do not.

    ``pinned`` keeps the optimizer from moving it: evaluated where it stands, once.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def found(texts):
        import pyarrow.compute as pc
        return pc.fill_null(pc.match_substring_regex(texts, pattern), False)

    return (found.asNondeterministic() if pinned else found)(text)


def with_rule_hits(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = ALL_RULES,
                   out_col: str = "_hits", validate: bool = True) -> DataFrame:
    """DataFrame form of ``rule_hits`` in two projections.

    Stage 1 extracts the raw matches of each rule (guarded by its prefilter);
    stage 2 recovers offsets (a ``split`` pass only where a rule matched) and
    applies validators. Staging keeps each regex pass evaluated exactly once:
    higher-order functions run interpreted and would otherwise re-evaluate a
    shared regex child.
    """
    t = F.col(text_col)
    raw_cols = []
    for k, r in enumerate(rules):
        h = raw_matches(t, to_java(r.pattern, r.ignore_case))
        g = _guard(t, r)
        if g is not None:
            h = F.when(g, h).otherwise(F.array().cast("array<string>"))
        raw_cols.append(F.when(t.isNull(), F.array().cast("array<string>")).otherwise(h).alias(f"_raw{k}"))
    staged = df.select("*", *raw_cols)
    # stage 2 as SQL text: one JVM parse per rule instead of many Py4J calls
    # per higher-order-function lambda
    t_sql = q_ident(text_col)
    arrays = []
    for k, r in enumerate(rules):
        raw = q_ident(f"_raw{k}")
        offs = offsets_sql(t_sql, raw, to_java(r.pattern, r.ignore_case))
        tagged = (f"transform({offs}, x -> named_struct('rule_ord', CAST({RULE_ORD.get(r.id, len(ALL_RULES) + k)} AS INT), "
                  f"'s', x.s, 'e', x.e, 'm', x.m))")
        if validate and r.validator:
            check = card_ok_sql("x.m") if r.validator == "card" else verhoeff_ok_sql("x.m")
            tagged = f"filter({tagged}, x -> {check})"
        arrays.append(f"CASE WHEN size({raw}) > 0 THEN {tagged} ELSE CAST(array() AS {HIT_TYPE}) END")
    out = F.expr(arrays[0] if len(arrays) == 1 else "concat(" + ", ".join(arrays) + ")")
    return staged.select(*df.columns, out.alias(out_col))


def _meta(ord_col: Column, attr: str, own: dict[int, Rule]) -> Column:
    vals = [getattr(r, attr) for r in ALL_RULES]
    if not own:
        return F.element_at(F.array(*[F.lit(v) for v in vals]), ord_col + 1)
    table = {**dict(enumerate(vals)), **{k: getattr(r, attr) for k, r in own.items()}}
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ord_col)


def own_rules(rules: Sequence[Rule]) -> dict[int, Rule]:
    """The caller's own rules by the number that their hits carry (after the built-in ones)."""
    return {len(ALL_RULES) + k: r for k, r in enumerate(rules) if r.id not in RULE_ORD}


def attach_rule_meta(df: DataFrame, ord_col: str = "rule_ord", rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    o, own = F.col(ord_col), own_rules(rules)
    return (df.withColumn("rule_id", _meta(o, "id", own))
              .withColumn("rule_name", _meta(o, "name", own))
              .withColumn("severity", _meta(o, "severity", own))
              .withColumn("severity_rank", _meta(o, "rank", own).cast("int"))
              .withColumn("confidence", _meta(o, "confidence", own).cast("double"))
              .withColumn("explanation", _meta(o, "explanation", own)))


def validated(findings: DataFrame, validators: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """The findings without those that their rule's validator turns down.

    A validator maps the matched text to a boolean Column: built-in functions or
    an Arrow UDF. It sees the matches of its own rule, never the texts.
    """
    for rule_id, accepts in validators.items():
        own = F.col("rule_id") == rule_id
        passed = accepts(F.when(own, F.col("matched")))
        findings = findings.where(F.col("rule_id").isNull() | ~own | F.coalesce(passed, F.lit(False)))
    return findings


FINDING_COLS = ["rule_id", "rule_name", "severity", "severity_rank", "start", "end", "matched",
                "confidence", "explanation", "rule_ord"]


def scan_text(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
              rules: Sequence[Rule] = ALL_RULES, keep_cols: Sequence[str] = (),
              outer: bool = False, validators: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Findings table: one row per validated rule hit.

    ``rules`` may hold the caller's own rules; ``validators`` (rule id to a function
    of the matched text) drops hits, see ``validated``.

    Columns: ``id_cols + keep_cols + FINDING_COLS``. Map-only (no shuffle).
    ``outer=True`` keeps one all-NULL finding row for texts without hits, so
    per-document aggregates need no join back to the text table.
    """
    cols = list(id_cols) + [c for c in keep_cols if c not in id_cols]
    hits = with_rule_hits(df.select(*cols, text_col), text_col, rules).drop(text_col)
    # explode_outer + filter: a plain explode makes Catalyst infer `size(hits) > 0`
    # and push that copy of the whole scan below the projection.
    exploded = hits.select(*cols, F.explode_outer("_hits").alias("_h"))
    if not outer:
        exploded = exploded.where(F.col("_h").isNotNull())
    out = exploded.select(*cols, F.col("_h.rule_ord").alias("rule_ord"),
                          F.col("_h.s").alias("start"), F.col("_h.e").alias("end"),
                          F.col("_h.m").alias("matched"))
    return validated(attach_rule_meta(out, rules=rules), validators or {}).select(*cols, *FINDING_COLS)


# ---------------------------------------------------------------------------
# Overlap handling and text rebuild (row-local)
# ---------------------------------------------------------------------------

def redact(df: DataFrame, text_col: str = "text", mode: str = "redact",
           rules: Sequence[Rule] = ALL_RULES, out_col: str = "redacted") -> DataFrame:
    """Add ``out_col`` (redacted text) and ``n_findings``. ``mode='warn'`` keeps text."""
    if mode == "warn":
        staged = with_rule_hits(df, text_col, rules)
        return staged.withColumn(out_col, F.col(text_col)).withColumn("n_findings", F.size("_hits")).drop("_hits")
    staged = _with_kept(df, text_col, rules)
    ids = _rule_attr_array_sql("id")
    red = rebuild_sql(q_ident(text_col), "`_kept`",
                      lambda h, _inside: f"concat('[REDACTED:', element_at({ids}, {h}.rule_ord + 1), ']')")
    return (staged.withColumn(out_col, F.expr(red)).withColumn("n_findings", F.size("_hits"))
                  .drop("_hits", "_kept"))


def mark_spans(df: DataFrame, text_col: str = "text", out_col: str = "marked",
               rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    staged = _with_kept(df, text_col, rules)
    sev = _rule_attr_array_sql("severity")
    marked = rebuild_sql(
        q_ident(text_col), "`_kept`",
        lambda h, inside: (f"concat('<span class=\"pg-u pg-', element_at({sev}, {h}.rule_ord + 1), '\">', "
                           f"{html_escape_sql(inside)}, '</span>')"),
        html_escape_sql)
    return staged.withColumn(out_col, F.expr(marked)).drop("_hits", "_kept")


# ---------------------------------------------------------------------------
# Finding-table operators
# ---------------------------------------------------------------------------

#: Up to so many hits of a text are compared pairwise in the JVM; beyond, an automaton finds the same hits.
PAIRWISE_HITS = 64


def contained_sql(hits: str) -> str:
    """SQL: the hits without those whose match lies in a longer one of at least their rank (all pairs)."""
    return (f"filter({hits}, f -> NOT exists({hits}, o -> element_at({RANKS_SQL}, o.rule_ord + 1) >= "
            f"element_at({RANKS_SQL}, f.rule_ord + 1) AND length(o.m) > length(f.m) AND instr(o.m, f.m) > 0))")


def drop_contained(df: DataFrame, hits: str = "_hits", where: Column | None = None) -> DataFrame:
    """``hits`` without those whose match lies in a longer one of at least their rank (of the same row).

    Row-local. Rows of few hits stay in the JVM; only the matches of rows with more
    than ``PAIRWISE_HITS`` go through the automaton of ``functions.containment``,
    which is linear where pairs are quadratic. ``where`` limits it to some rows.
    """
    from pyspark.sql.functions import arrow_udf

    from veilscan.functions.containment import uncontained
    ship_package(df.sparkSession)

    @arrow_udf("array<int>")
    def places(matches, ranks):
        import pyarrow as pa
        pairs = zip(matches.to_pylist(), ranks.to_pylist(), strict=True)
        return pa.array([None if m is None else uncontained(m, r) for m, r in pairs], pa.list_(pa.int32()))

    asked = F.lit(True) if where is None else where
    many = asked & (F.size(hits) > PAIRWISE_HITS)
    h = q_ident(hits)
    staged = df.withColumn("_places", places(
        F.when(many, F.expr(f"transform({h}, x -> x.m)")),
        F.when(many, F.expr(f"transform({h}, x -> element_at({RANKS_SQL}, x.rule_ord + 1))"))))
    left = (F.when(F.col("_places").isNotNull(), F.expr(f"transform(_places, k -> {h}[k])"))
             .when(asked, F.expr(contained_sql(h))).otherwise(F.col(hits)))
    return staged.withColumn(hits, left).drop("_places")


def scan_text_deduped(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
                      rules: Sequence[Rule] = ALL_RULES, keep_cols: Sequence[str] = ()) -> DataFrame:
    """``scan_text`` followed by contained-match dedupe per text value (row-local)."""
    cols = list(id_cols) + [c for c in keep_cols if c not in id_cols]
    hits = with_rule_hits(df.select(*cols, text_col), text_col, rules).drop(text_col)
    hits = drop_contained(hits)
    exploded = hits.select(*cols, F.explode_outer("_hits").alias("_h")).where(F.col("_h").isNotNull())
    out = exploded.select(*cols, F.col("_h.rule_ord").alias("rule_ord"),
                          F.col("_h.s").alias("start"), F.col("_h.e").alias("end"),
                          F.col("_h.m").alias("matched"))
    return attach_rule_meta(out).select(*cols, *FINDING_COLS)


def suppress(findings: DataFrame, ignored: DataFrame, keys: Sequence[str] = ("doc_id", "rule_id", "matched")) -> DataFrame:
    """Left anti join: drop findings whose (keys) appear in the ignore list.

    The ignore list is user-curated and small; it is broadcast only when Spark's
    size estimate is below the broadcast threshold (AQE decides at run time).
    """
    return findings.join(ignored.select(*keys).distinct(), on=list(keys), how="left_anti")


def gate(df: DataFrame, text_col: str = "text", threshold: str = "high",
         rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Row-local gate: worst rank, finding count and ``gate_failed`` per text row.

    No aggregation and no join: the worst severity is ``array_max`` over the
    row's hit array, so the gate costs one map-only pass.
    """
    t = 99 if threshold == "never" else SEVERITY_RANK[threshold]
    staged = with_rule_hits(df, text_col, rules)
    worst = F.expr(f"coalesce(array_max(transform(`_hits`, h -> element_at({RANKS_SQL}, h.rule_ord + 1))), 0)")
    return (staged.withColumn("worst_rank", worst)
                  .withColumn("n_findings", F.size("_hits"))
                  .withColumn("gate_failed", worst >= t)
                  .drop("_hits"))


def severity_counts(findings: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts by severity (one column each), with ``count_if`` (no pivot pass)."""
    aggs = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    aggs.append(F.count(F.lit(1)).alias("total"))
    if group_cols:
        return findings.groupBy(*group_cols).agg(*aggs)
    return findings.agg(*aggs)


def order_findings(findings: DataFrame, tie_cols: Iterable[str] = ("rule_ord", "start")) -> DataFrame:
    return findings.orderBy(F.desc("severity_rank"), *tie_cols)


def scan_text_raw(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
                  rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Regex candidates before validators (to audit the validators)."""
    cols = list(id_cols)
    hits = with_rule_hits(df.select(*cols, text_col), text_col, rules, validate=False).drop(text_col)
    exploded = hits.select(*cols, F.explode_outer("_hits").alias("_h")).where(F.col("_h").isNotNull())
    out = exploded.select(*cols, F.col("_h.rule_ord").alias("rule_ord"), F.col("_h.s").alias("start"),
                          F.col("_h.e").alias("end"), F.col("_h.m").alias("matched"))
    return attach_rule_meta(out).select(*cols, *FINDING_COLS)


def any_rule_hit(text: Column | str, rules: Sequence[Rule] = ALL_RULES) -> Column:
    """TRUE when at least one (validated) rule hit exists in the text.

    Existence only: one guarded ``rlike`` per rule, OR-ed so evaluation stops
    at the first rule that fires; validator rules extract and test candidates.
    """
    t = _col(text)
    out = None
    for r in rules:
        pat = to_java(r.pattern, r.ignore_case)
        if r.validator:
            check = card_ok if r.validator == "card" else verhoeff_ok
            c = F.exists(F.regexp_extract_all(t, F.lit("(" + pat + ")"), 1), check)
        else:
            c = t.rlike(pat)
        g = _guard(t, r)
        c = c if g is None else (g & c)
        out = c if out is None else (out | c)
    return F.coalesce(out, F.lit(False))


# ---------------------------------------------------------------------------
# SQL-text forms of the row-local array operators (cheap to build, see regex.py)
# ---------------------------------------------------------------------------

def _rule_attr_array_sql(attr: str) -> str:
    return "array(" + ", ".join(sql_str(str(getattr(r, attr))) for r in ALL_RULES) + ")"


RANKS_SQL = "array(" + ", ".join(str(r.rank) for r in ALL_RULES) + ")"


def drop_overlaps_sql(hits: str) -> str:
    """Sort by (start, end desc, rule_ord); keep first, skip hits starting before the last kept end."""
    ordered = (f"transform(array_sort(transform({hits}, x -> named_struct('k1', x.s, 'k2', -x.e, 'k3', x.rule_ord, "
               f"'h', x))), k -> k.h)")
    step = ("(acc, h) -> CASE WHEN h.s >= acc.last THEN named_struct('last', h.e, 'out', array_append(acc.out, h)) "
            "ELSE acc END")
    # each block's fold starts from the end the block before it left
    block = f"aggregate(b, named_struct('last', a.last, 'out', CAST(array() AS {HIT_TYPE})), {step})"
    fold = (f"aggregate({blocks_sql('od')}, named_struct('last', 0, 'outs', CAST(array() AS array<{HIT_TYPE}>)), "
            f"(a, b) -> {bind_sql('r', block, "named_struct('last', r.last, 'outs', array_append(a.outs, r.out))")}, "
            f"a -> flatten(a.outs))")
    return bind_sql("od", ordered, f"CASE WHEN size(od) > 0 THEN {fold} ELSE od END")


def rebuild_sql(text: str, kept: str, wrap, gap=lambda x: x) -> str:
    """Text with each kept span replaced by ``wrap(h, inside)``; gaps pass through ``gap``."""
    prev = f"CASE WHEN i = 0 THEN 0 ELSE element_at({kept}, i).e END"
    before = gap(f"substring({text}, {prev} + 1, h.s - ({prev}))")
    inside = f"substring({text}, h.s + 1, h.e - h.s)"
    body = f"array_join(transform({kept}, (h, i) -> concat({before}, {wrap('h', inside)})), '')"
    last = f"CASE WHEN size({kept}) > 0 THEN element_at({kept}, -1).e ELSE 0 END"
    tail = gap(f"substring({text}, ({last}) + 1, greatest(length({text}) - ({last}), 0))")
    return f"CASE WHEN {text} IS NULL THEN NULL ELSE concat({body}, {tail}) END"


def html_escape_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = f"replace({x}, {sql_str(a)}, {sql_str(b)})"
    return x


def _with_kept(df: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    staged = with_rule_hits(df, text_col, rules)
    # the fold in its own projection: the rebuild reads it many times
    return staged.withColumn("_kept", F.expr(drop_overlaps_sql("`_hits`")))
