"""Pinning, drift detection and continuous monitoring of tool definitions.

Pins are a table keyed by (config_path, tool_key). ``collect_tools`` numbers
repeated keys inside a document with row-local array functions;
``diff_pins`` is a full outer equi-join of two pin tables on the key;
``monitor`` is a left join of the current pins to the stored ones that also
returns the next version of the store. Both joins shuffle once on the key,
which spreads evenly (keys are unique per document).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilscan.functions.regex import explode_rows

from veilscan.functions.regex import JS_WS_CLASS, bind_sql, runs_sql, to_java
from veilscan.operators.tooldocs import FINDING_TYPE, POISON_RULES, _finding, tools_of

PIN_COLS = ["key", "name", "description", "schema_canonical", "annotations_canonical", "full_hash", "location"]

# Drift finding texts.
RUG_EXPL = ("A previously approved tool's description was changed after pinning, and the new text trips a "
            "tool-poisoning rule. This is the rug-pull pattern: a benign tool is approved, then silently swapped "
            "for a malicious one.")
DESC_EXPL = ("A previously approved tool's description changed. No malicious pattern detected, but review the "
             "change and re-pin if expected.")
SCHEMA_EXPL = ("A previously approved tool's input schema changed. Added parameters (especially free-text ones) "
               "can become a channel for injected or exfiltrated data. Review before continuing to use.")
ANN_EXPL = ("A tool's behavioral annotations changed after approval. A tool flipping from read-only to "
            "destructive after you trusted it is a privilege-escalation risk.")
ADDED_EXPL = ("A tool appeared that was not in the approved lockfile. New tools should be reviewed and "
              "re-pinned before use.")
REMOVED_EXPL = "A previously pinned tool is gone. Usually benign, but worth noting if unexpected."


def canonical_json(v: Column) -> Column:
    """Sorted-key compact JSON of a VARIANT ('null' when absent)."""
    return F.coalesce(F.to_json(v), F.lit("null"))


def hash_text(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def collect_tools(docs: DataFrame, path_col: str = "config_path", carry: Sequence[str] = ()) -> DataFrame:
    """Pins of every tool of every document: (config_path, key, name, ..., location).

    Key ``server/name`` (``(root)/name`` for top-level tools); the n-th repeat
    of a key inside one document gets ``#n``. Columns of ``carry`` are kept.
    """
    def base(t):
        v = F.try_variant_get(t["tool"], "$.name", "variant")
        name = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(t["tool"], "$.name", "string"))
        return F.struct(F.concat(F.coalesce(t["server"], F.lit("(root)")), F.lit("/"),
                                 F.coalesce(name, F.lit("(unnamed)"))).alias("base"),
                        F.coalesce(name, F.lit("(unnamed)")).alias("name"), t["loc"].alias("loc"),
                        t["tool"].alias("tool"))

    with_base = docs.select(
        path_col, *carry, F.transform(tools_of(F.col("doc")), base).alias("_t"))
    # the rank of a tool among those of its key: its place in the key's run of the sorted array
    sorted_keys = "sort_array(transform(`_t`, (x, i) -> named_struct('base', x.base, 'i', i)))"
    ranks = runs_sql(sorted_keys, "base", lambda rows, first, size: (
        f"transform(slice({rows}, {first} + 1, {size}), (x, n) -> named_struct('i', x.i, 'n', n))"))
    key = "CASE WHEN r[i].n > 0 THEN concat(t.base, '#', CAST(r[i].n AS STRING)) ELSE t.base END"
    numbered = bind_sql("r", f"sort_array(flatten({ranks}))", (
        f"transform(`_t`, (t, i) -> named_struct('key', {key}, 'name', t.name, 'loc', t.loc, 'tool', t.tool))"))

    ex = with_base.select(path_col, *carry, explode_rows(F.expr(numbered)).alias("t")).where(F.col("t").isNotNull())
    tool = F.col("t.tool")
    desc_v = F.try_variant_get(tool, "$.description", "variant")
    schema = F.coalesce(F.try_variant_get(tool, "$.inputSchema", "variant"),
                        F.try_variant_get(tool, "$.input_schema", "variant"))
    return ex.select(
        path_col, *carry, F.col("t.key").alias("key"), F.col("t.name").alias("name"),
        F.coalesce(F.when(F.schema_of_variant(desc_v) == "STRING", F.try_variant_get(tool, "$.description", "string")),
                   F.lit("")).alias("description"),
        canonical_json(schema).alias("schema_canonical"),
        canonical_json(F.try_variant_get(tool, "$.annotations", "variant")).alias("annotations_canonical"),
        hash_text(canonical_json(tool)).alias("full_hash"),
        F.col("t.loc").alias("location"))


def _snippet(c: Column, n: int = 60) -> Column:
    collapsed = F.regexp_replace(F.regexp_replace(c, f"[{JS_WS_CLASS}]+", " "), "^ | \\z", "")
    return F.when(F.length(collapsed) <= n, collapsed).otherwise(F.concat(F.substring(collapsed, 1, n), F.lit("...")))


def tripped_rule(text: Column) -> Column:
    """Id of the first poisoning rule (list order) the text trips, else NULL."""
    out = F.lit(None).cast("string")
    for r in reversed(POISON_RULES):
        out = F.when(text.rlike(to_java(r.pattern, ignore_case=True)), F.lit(r.id)).otherwise(out)
    return out


def compare_pins(prev: str = "p", cur: str = "c") -> Column:
    """ARRAY of up to three drift findings for a (previous, current) pin pair."""
    P = lambda c: F.col(f"{prev}.{c}")
    C = lambda c: F.col(f"{cur}.{c}")
    tripped = tripped_rule(C("description"))
    was_now = F.concat(F.lit('was: "'), _snippet(P("description")), F.lit('"  now: "'), _snippet(C("description")),
                       F.lit('"'))
    rug = _finding("rug_pull", "tool_changed",
                   F.concat(F.lit('RUG PULL: "'), C("name"), F.lit('" description changed to malicious content')),
                   "critical", 0.95, C("location"), F.concat(was_now, F.lit("  (trips "), tripped, F.lit(")")), RUG_EXPL,
                   ("LLM01", "LLM03", "T2"))
    desc = _finding("drift", "description_changed",
                    F.concat(F.lit('Description changed since pin: "'), C("name"), F.lit('"')), "medium", 0.85,
                    C("location"), was_now, DESC_EXPL, ("LLM03", "T2"))
    grew = F.length(C("schema_canonical")) > F.length(P("schema_canonical"))
    schema = _finding("drift", "schema_changed",
                      F.concat(F.lit('Input schema changed since pin: "'), C("name"), F.lit('"')),
                      F.when(grew, F.lit("high")).otherwise(F.lit("medium")), 0.8, C("location"),
                      F.when(grew, F.lit("schema gained fields after approval")).otherwise(F.lit("schema changed after approval")),
                      SCHEMA_EXPL, ("LLM03", "T2"))
    ann = _finding("drift", "annotations_changed",
                   F.concat(F.lit('Tool annotations changed since pin: "'), C("name"), F.lit('"')), "high", 0.8,
                   C("location"), "annotations (e.g. destructive/read-only hints) changed", ANN_EXPL, ("LLM03", "T3"))
    desc_changed = P("description") != C("description")
    return F.filter(F.array(
        F.when(desc_changed & tripped.isNotNull(), rug),
        F.when(desc_changed & tripped.isNull(), desc),
        F.when(P("schema_canonical") != C("schema_canonical"), schema),
        F.when(P("annotations_canonical") != C("annotations_canonical"), ann)), lambda x: x.isNotNull())


def diff_pins(current: DataFrame, lock: DataFrame, keys=("config_path", "key")) -> DataFrame:
    """Drift findings of current pins against a lock: added, removed, changed."""
    ks = list(keys)
    c = current.select(*ks, F.struct(*PIN_COLS).alias("c"))
    p = lock.select(*ks, F.struct(*PIN_COLS).alias("p"))
    j = c.join(p, ks, "full_outer")
    key = F.col("key")
    added = _finding("drift", "tool_added", F.concat(F.lit('New tool since pin: "'), F.col("c.name"), F.lit('"')),
                     "medium", 0.9, F.col("c.location"), F.concat(key, F.lit(" not present in the lockfile")),
                     ADDED_EXPL, ("LLM03", "T2"))
    removed_name = F.expr("substring(key, instr(key, '/') + 1)")
    removed = _finding("drift", "tool_removed", F.concat(F.lit('Pinned tool removed: "'), removed_name, F.lit('"')),
                       "low", 0.9, F.col("p.location"), F.concat(key, F.lit(" was pinned but is no longer present")),
                       REMOVED_EXPL, ("LLM03",))
    fs = (F.when(F.col("p").isNull(), F.array(added))
           .when(F.col("c").isNull(), F.array(removed))
           .otherwise(compare_pins("p", "c")))
    return j.select(*ks, explode_rows(fs).alias("f")).where(F.col("f").isNotNull()).select(*ks, "f.*")


def monitor(current: DataFrame, store: DataFrame, keys=("config_path", "key"),
            order_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One monitoring pass.

    Returns (findings, newly_pinned_count, next_store). Unseen keys are pinned
    silently; seen and changed keys report drift (location prefixed with the
    config path) and advance; unchanged and missing keys keep their pin. When a
    key occurs more than once, its occurrences are taken in ``order_col`` order
    (without one: by their hash), each compared with the one before it, and the
    last becomes the pin.
    """
    ks = list(keys)
    order = F.col(order_col) if order_col else F.col("full_hash")
    c = current.select(*ks, F.struct(*PIN_COLS).alias("c"), order.alias("_order"))
    p = store.select(*ks, F.struct(*PIN_COLS).alias("p"))
    turn = Window.partitionBy(*ks).orderBy("_order")
    j = c.withColumn("_before", F.lag("c").over(turn)).withColumn("_last", F.lead("c").over(turn).isNull())
    j = j.join(p, ks, "left").withColumn("p", F.coalesce("_before", "p"))
    drift = F.when(F.col("p").isNull(), F.array().cast(f"array<{FINDING_TYPE}>")).otherwise(compare_pins("p", "c"))
    j = j.withColumn("_d", drift)
    findings = j.select(*ks, explode_rows("_d").alias("f")).where(F.col("f").isNotNull()).select(*ks, "f.*").withColumn(
        "location", F.concat(F.col("config_path"), F.lit(" :: "), F.col("location")))
    newly = j.where(F.col("p").isNull()).agg(F.count(F.lit(1)).alias("newly_pinned"))
    extra = [k for k in ks if k not in PIN_COLS]
    moved = j.where("_last AND (p IS NULL OR _before IS NOT NULL OR size(_d) > 0)")
    advanced = moved.select(*extra, "c.*")
    kept = store.join(advanced.select(*ks), ks, "left_anti")
    next_store = advanced.unionByName(kept.select(*extra, *PIN_COLS))
    return findings, newly, next_store
