"""Tool-definition document scanning (poisoning, hidden unicode, shadowing,
hardcoded secrets in server configs, raw fallback for unparsable documents).

A document is parsed once into VARIANT. Everything that walks one document
(tools of every server, every string leaf and key of a tool, tool-name
collisions) is expressed with higher-order functions over that document's
VARIANT, i.e. row-local: no shuffle, no self-join, and work is bounded by the
size of the document. Only the per-value secret scan explodes to rows, and
that is a map-only pipeline as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import explode_rows

from veilscan.functions.regex import JS_WS_CLASS, q_ident, runs_sql, sql_str, to_java, to_re2
from veilscan.functions.rules import SEVERITY_RANK
from veilscan.operators import scan as S
from veilscan.session import allow_duplicate_keys, ship_package
from veilscan.sources.readers import tolerant_parse

#: Nesting levels that the projection chain walks; deeper documents go through the token pass.
LEVELS = 16
#: Bytes of strings in one batch of the token pass.
TOKEN_BATCH = 1 << 22

FINDING_SCHEMA_COLS = ["category", "rule_id", "title", "severity", "severity_rank", "confidence", "location",
                       "evidence", "explanation", "owasp"]


@dataclass(frozen=True)
class PoisonRule:
    id: str
    title: str
    pattern: str
    severity: str
    confidence: float
    explanation: str
    owasp: tuple[str, ...]
    # Lower-case substrings at least one of which every match contains (a
    # cheap `instr` guard derived from the pattern's mandatory words).
    keywords: tuple[str, ...] = ()


# ---------------------------------------------------------------------------
# Tool-poisoning rules (case-insensitive), in evaluation order.
# ---------------------------------------------------------------------------
POISON_RULES: list[PoisonRule] = [
    PoisonRule("instruction_override", "Instruction-override phrasing",
               r"\b(ignore|disregard|forget|override)\s+(all\s+|any\s+|the\s+|your\s+|previous\s+|prior\s+|above\s+)*(instructions?|rules?|prompts?|context|directions?)\b",
               "critical", 0.9,
               "Tool text instructs the model to ignore or override prior instructions. Tool descriptions should describe behavior, not redirect the model. Classic tool-poisoning / prompt-injection.",
               ("LLM01", "T2"), keywords=("ignore", "disregard", "forget", "override")),
    PoisonRule("hidden_from_user", "Instruction to hide actions from the user",
               r"\b(do not|don'?t|never)\s+(tell|inform|mention|show|reveal|disclose|notify)\s+(the\s+)?(user|human|person)\b|\b(secretly|silently|without\s+(telling|informing|notifying))\b",
               "critical", 0.88,
               "Tool text tells the model to conceal an action from the user. Legitimate tools have no reason to request secrecy. Strong indicator of a poisoned tool.",
               ("LLM01", "T2", "T6"), keywords=("not", "don", "never", "secretly", "silently", "without")),
    PoisonRule("embedded_directive_tags", "Embedded directive / system tags in description",
               r"<\s*(important|system|instructions?|secret|admin|s>|\/s>)\s*>|\[\s*(system|important|instructions?)\s*\]",
               "high", 0.8,
               "Description embeds pseudo-system tags (for example <important> or [system]) to smuggle directives into the model context. Descriptions are data, not a place for system instructions.",
               ("LLM01", "T2"), keywords=("<", "[")),
    PoisonRule("exfiltration_directive", "Exfiltration directive (read-and-send)",
               r"\b(reads?|reading|cat|loads?|loading|opens?|opening|accesses?|accessing|fetch(?:es)?|fetching)\b[^.]{0,40}\b(\.env|\.ssh|id_rsa|credentials?|secrets?|api[_\s-]?keys?|private[_\s-]?key|~\/\.|\/etc\/passwd)\b|\b(sends?|sending|forwards?|forwarding|posts?|posting|uploads?|uploading|exfiltrates?|bccs?|emails?|emailing)\b[^.]{0,40}\b(to|content|file|data|contents|result)\b",
               "critical", 0.75,
               "Tool text describes reading sensitive files or forwarding data elsewhere. Combined read-and-send instructions in a tool description are a hallmark of exfiltration tooling.",
               ("LLM01", "T2", "LLM06"), keywords=("read", "cat", "load", "open", "access", "fetch", "send", "forward", "post", "upload", "exfiltrat", "bcc", "email")),
    PoisonRule("tool_redirection", "Cross-tool redirection (shadowing language)",
               r"\b(instead of|rather than|do not use|don'?t use|in place of)\b[^.]{0,40}\b(tool|function|server|the other)\b|\b(before|prior to)\s+(using|calling|invoking)\b[^.]{0,40}\b(any|other|each|every)\b[^.]{0,20}\btool\b",
               "high", 0.7,
               "Tool text references or redirects the use of other tools. Tool shadowing works by one server's description hijacking how the model uses a different, trusted tool.",
               ("LLM01", "T2"), keywords=("instead of", "rather than", "not use", "don", "in place of", "before", "prior to")),
    PoisonRule("imperative_to_model", "Imperative command aimed at the model",
               r"\b(you must|you should always|always (call|use|run|send|include)|make sure to (call|send|include|attach)|it is (required|mandatory) that you)\b",
               "medium", 0.55,
               "Description issues imperative commands to the model rather than describing the tool. Low on its own, but a common carrier for injected behavior; weigh with other findings.",
               ("LLM01", "T2"), keywords=("you must", "you should always", "always", "make sure to", "it is required", "it is mandatory")),
]

# Hidden-unicode classes (code point sets), severities, texts.
UNICODE_CLASSES = [
    ("zero_width", "Zero-width / invisible characters", r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "high",
     "Zero-width or invisible characters in the text. Used to hide content from human reviewers while the model still reads it."),
    ("bidi_override", "Bidirectional override characters", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", "high",
     "Bidirectional override characters can reorder how text is displayed versus how it is read, hiding malicious content from reviewers (Trojan Source style)."),
    ("tag_chars", "Unicode tag characters", r"[\x{E0000}-\x{E007F}]", "critical",
     "Unicode tag characters are invisible and can encode hidden instructions that models interpret. There is no legitimate reason for these in a tool description."),
]

# Texts of the structural findings.
SHADOW_EXPLANATION = ("The same tool name is defined by more than one server or entry. A malicious server can shadow "
                      "a trusted tool by claiming its name, so the model calls the attacker's version.")
PARSE_EXPLANATION = ("The input was not valid JSON, so tool-poisoning and shadowing checks were skipped. "
                     "Only a raw secret scan ran.")
CONFIG_TITLE, RAW_TITLE = "Hardcoded secret in config: ", "Hardcoded secret: "
PARSE_TITLE, PARSE_EVIDENCE = "Could not parse as JSON", "structural checks skipped"
CONFIG_SUFFIX = " Hardcoded directly in an MCP config file; move it to an environment variable or secret manager."


def redact_evidence(c: Column, n: int = 48) -> Column:
    collapsed = F.regexp_replace(F.regexp_replace(c, f"[{JS_WS_CLASS}]+", " "), f"^ | \\z", "")
    return F.when(F.length(collapsed) <= n, collapsed).otherwise(F.concat(F.substring(collapsed, 1, n), F.lit("...")))


def _finding(category, rule_id, title, severity, confidence, location, evidence, explanation, owasp) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    sev = lit(severity)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), sev)
    ow = owasp if isinstance(owasp, Column) else F.array(*[F.lit(o) for o in owasp]).cast("array<string>")
    return F.struct(lit(category).alias("category"), lit(rule_id).alias("rule_id"), lit(title).alias("title"),
                    sev.alias("severity"), rank.cast("int").alias("severity_rank"),
                    lit(confidence).cast("double").alias("confidence"), lit(location).alias("location"),
                    lit(evidence).alias("evidence"), lit(explanation).alias("explanation"), ow.alias("owasp"))


FINDING_TYPE = ("struct<category:string,rule_id:string,title:string,severity:string,severity_rank:int,"
                "confidence:double,location:string,evidence:string,explanation:string,owasp:array<string>>")


# ---------------------------------------------------------------------------
# VARIANT helpers
# ---------------------------------------------------------------------------

def _as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


TOOL_TYPE = "array<struct<server:string,idx:int,loc:string,shadow_loc:string,tool:variant>>"


def tools_of_sql(doc: str = "doc") -> str:
    """SQL: ARRAY<STRUCT<server, idx, loc, shadow_loc, tool>> over mcpServers, servers, root tools."""
    d = q_ident(doc)
    empty_map = "CAST(map() AS map<string,variant>)"
    empty_arr = "CAST(array() AS array<variant>)"

    def server_tools(map_name: str) -> str:
        return (f"flatten(transform(map_entries(coalesce(try_variant_get({d}, '$.{map_name}', 'map<string,variant>'), {empty_map})), "
                f"e -> transform(coalesce(try_variant_get(e.value, '$.tools', 'array<variant>'), {empty_arr}), "
                f"(t, i) -> named_struct('server', e.key, 'idx', i, "
                f"'loc', concat('mcpServers.', e.key, '.tools[', CAST(i AS STRING), ']'), "
                f"'shadow_loc', concat(e.key, '.tools[', CAST(i AS STRING), ']'), 'tool', t))))")

    root = (f"transform(coalesce(try_variant_get({d}, '$.tools', 'array<variant>'), {empty_arr}), "
            f"(t, i) -> named_struct('server', CAST(NULL AS STRING), 'idx', i, "
            f"'loc', concat('tools[', CAST(i AS STRING), ']'), 'shadow_loc', concat('tools[', CAST(i AS STRING), ']'), "
            f"'tool', t))")
    return f"concat({server_tools('mcpServers')}, {server_tools('servers')}, {root})"


def tools_of(doc="doc") -> Column:
    """Column form of ``tools_of_sql``; ``doc`` is a column name (or ``F.col(name)``)."""
    name = doc if isinstance(doc, str) else "doc"
    return F.expr(tools_of_sql(name))


NODE_TYPE = "array<struct<path:string,v:variant>>"
LEAF_TYPE = "array<struct<path:string,text:string>>"


def _redact_sql(x: str, n: int) -> str:
    c = (f"regexp_replace(regexp_replace({x}, {sql_str('[' + JS_WS_CLASS + ']+')}, ' '), "
         f"{sql_str('^ | ' + chr(92) + 'z')}, '')")
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE concat(substring({c}, 1, {n}), '...') END"


def _step_sql(nodes: str) -> tuple[str, str]:
    """One level of the walk as SQL: (child nodes, string leaves incl. object keys)."""
    as_map = "try_variant_get(x.v, '$', 'map<string,variant>')"
    as_arr = "try_variant_get(x.v, '$', 'array<variant>')"
    kids = (f"flatten(transform({nodes}, x -> CASE "
            f"WHEN {as_map} IS NOT NULL THEN transform(map_entries({as_map}), "
            f"e -> named_struct('path', concat(x.path, '.', e.key), 'v', e.value)) "
            f"WHEN {as_arr} IS NOT NULL THEN transform({as_arr}, "
            f"(e, i) -> named_struct('path', concat(x.path, '[', CAST(i AS STRING), ']'), 'v', e)) "
            f"ELSE CAST(array() AS {NODE_TYPE}) END))")
    strings = (f"transform(filter({nodes}, x -> schema_of_variant(x.v) = 'STRING'), "
               f"x -> named_struct('path', x.path, 'text', try_variant_get(x.v, '$', 'string')))")
    keys = (f"flatten(transform({nodes}, x -> transform(map_keys(coalesce({as_map}, CAST(map() AS map<string,variant>))), "
            f"k -> named_struct('path', concat(x.path, '.<key:', {_redact_sql('k', 24)}, '>'), 'text', k))))")
    return kids, f"concat({strings}, {keys})"


def _depths(texts: Column, comments: bool = False) -> Column:
    """Deepest nesting of brackets outside of strings; with ``comments`` NULL where a slash is left outside of them."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("int")
    def depths(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        bare = pc.replace_substring_regex(pc.replace_substring_regex(texts, r"(?s)\\.", ""), r'"[^"]*"', "")
        doubt = pc.or_kleene(pc.is_null(bare), pc.match_substring(bare, "/")) if comments else pc.is_null(bare)
        kept = pc.fill_null(pc.replace_substring_regex(bare, r"[^\[\]{}]+", ""), "").to_pylist()
        ends = np.cumsum([len(k) for k in kept])
        marks = np.frombuffer("".join(kept).encode("ascii"), np.uint8)
        level = np.cumsum(np.where((marks == ord("{")) | (marks == ord("[")), 1, -1))
        found = np.zeros(len(kept), np.int32)
        for k, (end, size) in enumerate(zip(ends, np.diff(ends, prepend=0))):
            if size:
                first = end - size
                found[k] = max(level[first:end].max() - (level[first - 1] if first else 0), 0)
        return pc.if_else(doubt, pa.scalar(None, pa.int32()), pa.array(found))

    return depths(texts)


def with_depth(docs: DataFrame, raw_col: str | None = None, doc_col: str = "doc", out: str = "_depth") -> DataFrame:
    """Adds the deepest nesting of objects and arrays in each document.

    Read off the raw text where it is given: without escapes and strings, what
    is left of a JSON text are its brackets. Only a text that still holds a
    slash then (a comment) is parsed for it.
    """
    if raw_col is None or raw_col not in docs.columns:
        return docs.withColumn(out, F.coalesce(_depths(F.to_json(F.col(doc_col))), F.lit(0)))
    own = docs.withColumn("_own", _depths(F.col(raw_col), comments=True))
    clean = F.when(F.col("_own").isNull(), F.coalesce(F.to_json(tolerant_parse(F.col(raw_col))), F.col(raw_col)))
    return own.withColumn(out, F.coalesce("_own", _depths(clean), F.lit(0))).drop("_own")


def nesting_depth(docs: DataFrame, raw_col: str | None = None, doc_col: str = "doc") -> int:
    """Deepest nesting in all documents (one aggregate)."""
    return with_depth(docs, raw_col, doc_col).agg(F.coalesce(F.max("_depth"), F.lit(0))).first()[0]


def walk_strings(df: DataFrame, depth: int, tool_col: str = "tool", loc_col: str = "loc",
                 out_col: str = "strings") -> DataFrame:
    """Adds ``strings`` ARRAY<STRUCT<path, text>>: string leaves and object keys of the tool.

    One row-local projection for each nesting level down to ``depth`` (see
    ``nesting_depth``), for documents of up to ``LEVELS`` levels; ``deep_entries``
    reads deeper ones.
    """
    cur = df.withColumn("_nodes", F.when(F.col(tool_col).isNull(), F.array().cast(NODE_TYPE)).otherwise(
        F.array(F.struct(F.col(loc_col).alias("path"), F.col(tool_col).alias("v")))))
    kids, leaves = _step_sql("`_nodes`")
    cur = cur.withColumn(out_col, F.array().cast(LEAF_TYPE))
    for _ in range(depth + 1):
        cur = (cur.withColumn(out_col, F.expr(f"concat({q_ident(out_col)}, {leaves})"))
                  .withColumn("_nodes", F.expr(kids)))
    return cur.drop("_nodes")


def split_by_depth(docs: DataFrame, raw_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """(documents of up to ``LEVELS`` levels, deeper ones or None, levels to walk)."""
    depth = nesting_depth(docs, raw_col)
    if depth <= LEVELS or raw_col not in docs.columns:
        return docs, None, depth
    measured = with_depth(docs, raw_col)
    return measured.where(F.col("_depth") <= LEVELS).drop("_depth"), measured.where(F.col("_depth") > LEVELS).drop("_depth"), LEVELS


def deep_entries(docs: DataFrame, ids: list[str], raw_col: str = "raw") -> DataFrame:
    """(ids, kind, path, text, n) of what there is to check in documents of any depth (see ``jsontokens.entries``).

    One pass over each text's tokens; nothing is parsed by levels, so JSON that no
    parser takes for its depth is walked whole as well.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*ids, F.col(raw_col).alias("_raw")).where(F.col("_raw").isNotNull())

    def run(batches):
        import pyarrow as pa

        from veilscan.functions.jsontokens import entries

        def send(batch, at, held):
            columns = [pa.array([h[c] for h in held], t) for c, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32()))]
            one = [batch.column(c).take(pa.array([at] * len(held), pa.int64())) for c in range(len(ids))]
            return pa.RecordBatch.from_arrays([*one, *columns], names=[*ids, "kind", "_path", "text", "_key", "n"])

        for batch in batches:
            for at, raw in enumerate(batch.column(len(ids))):
                held, size = [], 0
                for entry in entries(raw.as_py()):
                    held.append(entry)
                    size += len(entry[1] or "") + len(entry[2])
                    if size > TOKEN_BATCH:
                        yield send(batch, at, held)
                        held, size = [], 0
                yield send(batch, at, held)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids)
    found = rows.mapInArrow(run, f"{kinds}, kind string, _path string, text string, _key boolean, n int")
    path = F.expr(f"CASE WHEN _key THEN concat(_path, '.<key:', {_redact_sql('text', 24)}, '>') ELSE _path END")
    return found.withColumn("path", path).select(*ids, "kind", "path", "text", "n")


_ANY_HIDDEN = "[" + "".join(c[2][1:-1] for c in UNICODE_CLASSES) + "]"


def _in_json(pattern: str) -> str:
    """The pattern as it may stand in JSON text: looser, as escapes stand for white space and slashes and lengthen what lies between words."""
    loose = re.sub(r"\[\^\.\]\{0,\d+\}", "[^.]*", pattern).replace(r"\b", "")
    loose = loose.replace(r"[_\s-]", "\0").replace(r"\s", r"(?:[\s]|\\[fnrt])").replace("\0", r"(?:[_\s-]|\\[fnrt])")
    return loose.replace(r"\/", r"\\?\/")


#: What a string must match to have a finding, and what a JSON text must match for one of its strings to have one. A text with
#: code point escapes, comments or trailing commas (``tolerant_parse`` takes them out) always counts.
_STRING_TRIPS = "|".join([f"(?:{to_re2(r.pattern, True)})" for r in POISON_RULES] + [_ANY_HIDDEN])
_TEXT_TRIPS = "|".join([f"(?:{to_re2(_in_json(r.pattern), True)})" for r in POISON_RULES]
                       + [_ANY_HIDDEN, r"\\u", r"/\*", r"(?m:^|[^:])//", r",[\s\x0B]*[}\]]"])


def string_findings(text: Column, location: Column) -> Column:
    """ARRAY of poisoning (first match per rule) and hidden-unicode findings for one string."""
    out = []
    for r in POISON_RULES:
        pat = to_java(r.pattern, ignore_case=True)
        m = F.regexp_extract(text, pat, 0)
        out.append(F.when(text.rlike(pat), _finding("tool_poisoning", r.id, r.title, r.severity, r.confidence,
                                                    location, redact_evidence(m), r.explanation, r.owasp)))
    # pure-ASCII strings (byte length == character length) cannot hold any of
    # the hidden code points; one combined class gates the three class checks
    non_ascii = (F.octet_length(text) > F.length(text)) & text.rlike(_ANY_HIDDEN)
    for cid, title, cls, sev, expl in UNICODE_CLASSES:
        out.append(F.when(non_ascii & text.rlike(cls), _finding("hidden_unicode", f"unicode_{cid}", title, sev, 0.95, location,
                                                     f"{title} present (rendered invisible)", expl, ("LLM01", "T2"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def parse_documents(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``doc``: the VARIANT of an object or array; NULL for anything else, which gets the raw scan."""
    allow_duplicate_keys(df.sparkSession)
    parsed = df.withColumn("doc", tolerant_parse(F.col(raw_col)))
    return parsed.withColumn("doc", F.when(F.schema_of_variant("doc").rlike("^(OBJECT|ARRAY)"), F.col("doc")))


def tool_rows(docs: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    """One row per tool: (ids, server, idx, loc, shadow_loc, name, tool)."""
    ids = list(id_cols)
    t = docs.select(*ids, explode_rows(tools_of(F.col("doc"))).alias("_t")).where(F.col("_t").isNotNull())
    return t.select(*ids, "_t.server", "_t.idx", "_t.loc", "_t.shadow_loc",
                    F.try_variant_get("_t.tool", "$.name", "string").alias("name"), F.col("_t.tool").alias("tool"))


def poison_findings(docs: DataFrame, id_cols=("doc_id",), raw_col: str = "raw") -> DataFrame:
    """Poisoning + hidden unicode over every string leaf / key of every tool.

    Only documents whose text may hold a finding are walked (one regex pass over
    every text), and only strings that trip go through the rules.
    """
    ids = list(id_cols)
    if raw_col in docs.columns:
        docs = docs.where(S.trips(F.col(raw_col), _TEXT_TRIPS))
    docs, deep, depth = split_by_depth(docs, raw_col)
    tools = walk_strings(tool_rows(docs, ids), depth)
    strings = tools.select(*ids, explode_rows("strings").alias("s")).where(F.col("s").isNotNull()).select(*ids, "s.path", "s.text")
    if deep is not None:
        strings = strings.unionByName(deep_entries(deep, ids, raw_col).where("kind = 'tool'").select(*ids, "path", "text"))
    strings = strings.where(S.trips(F.col("text"), _STRING_TRIPS))
    per = strings.select(*ids, string_findings(F.col("text"), F.col("path")).alias("_f"))
    # explode_outer + null filter: a plain explode lets Catalyst infer and push
    # down a size(_f) > 0 filter that evaluates every regex a second time
    ex = per.select(*ids, F.explode_outer("_f").alias("f")).where(F.col("f").isNotNull())
    return ex.select(*ids, "f.*")


def shadow_array() -> Column:
    """ARRAY of findings: tool names defined more than once in the document ``doc`` (row-local)."""
    name = "try_variant_get(t.tool, '$.name', 'variant')"
    named = (f"filter(transform({tools_of_sql()}, t -> named_struct('name', CASE WHEN schema_of_variant({name}) = 'STRING' "
             f"THEN try_variant_get(t.tool, '$.name', 'string') END, 'loc', t.shadow_loc)), x -> x.name <> '')")
    keyed = f"sort_array(transform({named}, (x, i) -> named_struct('name', x.name, 'i', i, 'loc', x.loc)))"
    groups = runs_sql(keyed, "name", lambda rows, first, size: (
        f"named_struct('name', {rows}[{first}].name, 'locs', transform(slice({rows}, {first} + 1, {size}), x -> x.loc))"))
    return F.transform(F.expr(f"filter({groups}, g -> size(g.locs) > 1)"),
                       lambda g: _shadow_finding(g["name"], F.array_join(g["locs"], ", "), F.size(g["locs"])))


def _shadow_finding(name: Column, places: Column, times: Column) -> Column:
    return _finding("tool_shadowing", "duplicate_tool_name", F.concat(F.lit('Tool name collision: "'), name, F.lit('"')), "high", 0.85,
                    places, F.concat(F.lit('"'), name, F.lit('" defined '), times.cast("string"), F.lit(" times")),
                    SHADOW_EXPLANATION, ("LLM01", "T2"))


def shadowing_findings(docs: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    """Tool names defined more than once in one document (row-local grouping)."""
    ids = list(id_cols)
    ex = docs.select(*ids, explode_rows(shadow_array()).alias("f"))
    return ex.where(F.col("f").isNotNull()).select(*ids, "f.*")


def config_array() -> Column:
    """ARRAY<STRUCT<path, text>>: command, string args, string env values and url of every server of ``doc``."""
    def per_map(map_name):
        return F.map_entries(F.coalesce(_as_map(F.try_variant_get(F.col("doc"), f"$.{map_name}", "variant")),
                                        F.create_map().cast("map<string,variant>")))

    def server(e):
        v, name = e["value"], e["key"]

        def str_at(path):
            x = F.try_variant_get(v, path, "variant")
            return F.when(_is_string(x), _str(x))

        cmd = F.array(F.struct(F.concat(name, F.lit(".command")).alias("path"), str_at("$.command").alias("text")))
        url = F.array(F.struct(F.concat(name, F.lit(".url")).alias("path"), str_at("$.url").alias("text")))
        args = F.transform(F.coalesce(_as_array(F.try_variant_get(v, "$.args", "variant")), F.array().cast("array<variant>")),
                           lambda a, i: F.struct(F.concat(name, F.lit(".args["), i.cast("string"), F.lit("]")).alias("path"),
                                                 F.when(_is_string(a), _str(a)).alias("text")))
        env = F.transform(F.map_entries(F.coalesce(_as_map(F.try_variant_get(v, "$.env", "variant")),
                                                   F.create_map().cast("map<string,variant>"))),
                          lambda kv: F.struct(F.concat(name, F.lit(".env."), kv["key"]).alias("path"),
                                              F.when(_is_string(kv["value"]), _str(kv["value"])).alias("text")))
        return F.concat(cmd, args, env, url)

    values = F.flatten(F.transform(F.concat(per_map("mcpServers"), per_map("servers")), server))
    return F.filter(values, lambda x: x["text"].isNotNull())


def config_values(docs: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    """(ids, path, text) for command, string args, string env values and url of every server."""
    ids = list(id_cols)
    vals = docs.select(*ids, explode_rows(config_array()).alias("c"))
    return vals.where(F.col("c").isNotNull()).select(*ids, "c.path", "c.text")


def _config_finding() -> Column:
    return _finding("secret_in_config", F.col("rule_id"), F.concat(F.lit(CONFIG_TITLE), F.col("rule_name")),
                    F.col("severity"), F.col("confidence"), F.concat(F.lit("mcpServers."), F.col("path")),
                    redact_evidence(F.col("matched")), F.concat(F.col("explanation"), F.lit(CONFIG_SUFFIX)), ("LLM06", "T3"))


def _raw_finding() -> Column:
    return _finding("secret_in_config", F.col("rule_id"), F.concat(F.lit(RAW_TITLE), F.col("rule_name")),
                    F.col("severity"), F.col("confidence"),
                    F.concat(F.lit("(raw text, offset "), F.col("start").cast("string"), F.lit(")")),
                    redact_evidence(F.col("matched")), F.col("explanation"), ("LLM06",))


def _parse_warning() -> Column:
    return _finding("parse_warning", "parse_failed", PARSE_TITLE, "low", 1.0, "(file)",
                    PARSE_EVIDENCE, PARSE_EXPLANATION, F.array().cast("array<string>"))


def config_secret_findings(docs: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    ids = list(id_cols)
    f = S.scan_text_deduped(config_values(docs, ids), text_col="text", id_cols=ids + ["path"])
    return f.select(*ids, _config_finding().alias("f")).select(*ids, "f.*")


def fallback_findings(docs: DataFrame, id_cols=("doc_id",), raw_col: str = "raw") -> DataFrame:
    """Unparsable documents: raw secret scan + one low ``parse_failed`` finding."""
    ids = list(id_cols)
    bad = docs.where(F.col("doc").isNull()).select(*ids, raw_col)
    f = S.scan_text(bad, text_col=raw_col, id_cols=ids)
    secrets = f.select(*ids, _raw_finding().alias("f")).select(*ids, "f.*")
    return secrets.unionByName(bad.select(*ids, _parse_warning().alias("f")).select(*ids, "f.*"))


def scan_documents(docs: DataFrame, id_cols=("doc_id",), raw_col: str = "raw") -> DataFrame:
    """All tool-document findings: config secrets, poisoning, unicode, shadowing, fallback.

    One pass: a document is parsed once into the list of what there is to check
    (its tools, its configuration values, or its raw text) and the findings that
    need the whole document; each entry becomes a row, a tool's row becomes its
    strings, and both rule families run on that row.
    """
    ids = list(id_cols)
    # a document's strings are walked only where its text may hold a poisoning finding
    docs = docs.withColumn("_walk", S.trips(F.col(raw_col), _TEXT_TRIPS, pinned=True) if raw_col in docs.columns else F.lit(True))
    parsed = docs if "doc" in docs.columns else parse_documents(docs, raw_col)
    parsed, deep, depth = split_by_depth(parsed, raw_col)
    null = lambda t: F.lit(None).cast(t)

    def item(kind, path=None, text=None, tool=None, f=None):
        return F.struct(F.lit(kind).alias("kind"), (null("string") if path is None else path).alias("path"),
                        (null("string") if text is None else text).alias("text"),
                        (null("variant") if tool is None else tool).alias("tool"),
                        (null(FINDING_TYPE) if f is None else f).alias("f"))

    tools = F.when(F.col("_walk"), tools_of(F.col("doc"))).otherwise(F.array().cast(TOOL_TYPE))
    whole = F.concat(F.transform(tools, lambda t: item("tool", t["loc"], tool=t["tool"])),
                     F.transform(config_array(), lambda c: item("config", c["path"], c["text"])),
                     F.transform(shadow_array(), lambda f: item("done", f=f)))
    broken = F.array(item("raw", text=F.col(raw_col)), item("done", f=_parse_warning()))
    items = parsed.select(*ids, explode_rows(F.when(F.col("doc").isNull(), broken).otherwise(whole)).alias("i"))
    items = items.where(F.col("i").isNotNull()).select(*ids, "i.*")
    walked = walk_strings(items, depth, "tool", "path")
    own = F.array(F.struct(F.col("path"), F.col("text")))
    rows = walked.select(*ids, "kind", "f", explode_rows(F.when(F.col("kind") == "tool", F.col("strings")).otherwise(own)).alias("s"))
    rows = rows.where(F.col("s").isNotNull()).select(*ids, "kind", "f", "s.path", "s.text")
    if deep is not None:
        more = deep_entries(deep, ids, raw_col)
        ready = F.when(F.col("kind") == "shadow", _shadow_finding(F.col("text"), F.col("path"), F.col("n")))
        found = more.select(*ids, F.when(F.col("kind") == "shadow", F.lit("done")).otherwise(F.col("kind")).alias("kind"), ready.cast(FINDING_TYPE).alias("f"), "path", "text")
        broken = more.where("kind = 'raw'").select(*ids, F.lit("done").alias("kind"), _parse_warning().cast(FINDING_TYPE).alias("f"), "path", "text")
        rows = rows.unionByName(found).unionByName(broken)
    # an entry that trips no rule has no finding
    asked = rows.select("*", S.trips(F.when(F.col("kind") == "tool", F.col("text")), _STRING_TRIPS, pinned=True).alias("_trips"),
                        S.trips(F.when(F.col("kind").isin("config", "raw"), F.col("text")), S.ANY_RULE, pinned=True).alias("_risky"))
    rows = asked.where("kind = 'done' OR _trips OR _risky").withColumn("_secret", F.when(F.col("_risky"), F.col("text"))).drop("_risky")
    hits = S.drop_contained(S.with_rule_hits(rows, "_secret"), where=F.col("kind") == "config")
    poison = F.when(F.col("_trips"), string_findings(F.col("text"), F.col("path"))).otherwise(F.array().cast(f"array<{FINDING_TYPE}>"))
    ready = F.when(F.col("f").isNull(), poison).otherwise(F.array("f"))
    found = hits.select(*ids, "kind", "path", explode_rows(F.concat(
        F.transform(ready, lambda f: F.struct(f.alias("f"), null(S.HIT_STRUCT).alias("h"))),
        F.transform("_hits", lambda h: F.struct(null(FINDING_TYPE).alias("f"), h.alias("h"))))).alias("x")).where(F.col("x").isNotNull())
    found = found.select(*ids, "kind", "path", F.col("x.f").alias("f"), F.col("x.h.rule_ord").alias("rule_ord"),
                         F.col("x.h.s").alias("start"), F.col("x.h.m").alias("matched"))
    named = S.attach_rule_meta(found)
    f = F.when(F.col("f").isNotNull(), F.col("f")).when(F.col("kind") == "config", _config_finding()).otherwise(_raw_finding())
    return named.select(*ids, f.alias("f")).select(*ids, "f.*")


def document_counts(docs: DataFrame, id_cols=("doc_id",)) -> DataFrame:
    """Per document: parsed flag, servers scanned, tools scanned."""
    ids = list(id_cols)
    d = F.col("doc")

    def n_servers(map_name):
        return F.coalesce(F.size(_as_map(F.try_variant_get(d, f"$.{map_name}", "variant"))), F.lit(0))

    n_srv = F.greatest(n_servers("mcpServers"), F.lit(0)) + F.greatest(n_servers("servers"), F.lit(0))
    return docs.select(*ids, d.isNotNull().alias("parsed"),
                       F.when(d.isNotNull(), n_srv).otherwise(0).alias("servers_scanned"),
                       F.when(d.isNotNull(), F.size(tools_of("doc"))).otherwise(0).alias("tools_scanned"))
