"""Prompt rewriting: optimisation suggestions, level-based compression, flags.

All rewrites are chains of ``regexp_replace`` (JVM, codegen) over the text
column. The optimisation log needs every intermediate string of the chain; it
is built in two projections (intermediates, then per-step match extraction)
so the chain is evaluated once per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.regex import JS_WS_CLASS, to_java


@dataclass(frozen=True)
class Substitution:
    pattern: str        # portable dialect, always case-insensitive and global
    replacement: str
    category: str
    description: str


# ---------------------------------------------------------------------------
# The 16 ordered optimisation substitutions.
# ---------------------------------------------------------------------------
SUBSTITUTIONS: list[Substitution] = [
    Substitution(r"\b(could|can|would|will) you (please |kindly )?", "", "filler_removal", "removed soft request opener"),
    Substitution(r"\bplease\b ?", "", "filler_removal", "removed 'please'"),
    Substitution(r"\bI (would like|want|need) (you )?to ", "", "filler_removal", "removed verbose request opener"),
    Substitution(r"\bif (it'?s )?(possible|you can|you'?d like|you don'?t mind),?\s*", "", "hedging", "removed hedge"),
    Substitution(r"\bthank(s| you)( so much)?( in advance)?[!.]?\s*$", "", "filler_removal", "removed trailing thanks"),
    Substitution(r"\bI('?d| would)( really| truly| greatly)? appreciate (it|that|your help)( with (this|that))?[,.]?\s*",
                 "", "filler_removal", "removed appreciation filler"),
    Substitution(r"\b(when you (get a chance|have (a )?(moment|time|second))|if you have a moment),?\s*", "",
                 "filler_removal", "removed availability hedge"),
    Substitution(r"\bin order to\b", "to", "verbose_phrase", "tightened 'in order to' to 'to'"),
    Substitution(r"\bdue to the fact that\b", "because", "verbose_phrase", "tightened 'due to the fact that' to 'because'"),
    Substitution(r"\bat this point in time\b", "now", "verbose_phrase", "tightened 'at this point in time' to 'now'"),
    Substitution(r"\bfor the purpose of\b", "to", "verbose_phrase", "tightened 'for the purpose of' to 'to'"),
    Substitution(r"\bin the event that\b", "if", "verbose_phrase", "tightened 'in the event that' to 'if'"),
    Substitution(r"\bwith regards? to\b", "about", "verbose_phrase", "tightened 'with regard(s) to' to 'about'"),
    Substitution(r"\ba (large|huge|massive|significant) number of\b", "many", "verbose_phrase", "tightened to 'many'"),
    Substitution(r"\bI'?m not sure if this is (right|correct),?\s*but,?\s*", "", "hedging", "removed uncertainty hedge"),
    Substitution(r"\bthis (might|may) be a (silly|dumb|basic|stupid) question,?\s*but,?\s*", "", "hedging",
                 "removed self-deprecating hedge"),
]

# Imperative task verbs accepted as a prompt's first word.
TASK_VERBS = ["write", "create", "generate", "explain", "describe", "analyze", "compare", "summarize",
              "translate", "list", "show", "build", "design", "fix", "debug", "review", "find", "count",
              "extract", "convert", "refactor", "rewrite", "draft", "improve", "optimize", "evaluate",
              "rank", "classify", "calculate", "compute", "implement", "deploy"]

# Structural-issue texts.
ISSUE_TASK_VERB = ("missing_task_verb", "Prompt does not start with a direct task verb.",
                   "Consider starting with an imperative such as Write, Explain, Generate, or Analyze so the model "
                   "knows exactly what action to take.")
ISSUE_FORMAT = ("missing_output_format", "No output format is specified.",
                "Specify the desired output shape, for example 'respond as a bulleted list', 'in JSON', or "
                "'in markdown', to reduce iteration.")
REASON_SHORT = "Prompt is too short to meaningfully optimize."
REASON_CONCISE = "Prompt is already concise and well-structured; no meaningful optimization available."

WS = f"[{JS_WS_CLASS}]"


def approx_tokens(c: Column) -> Column:
    """ceil(length / 4), length in code points."""
    return F.ceil(F.length(c) / 4).cast("int")


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def _sub(c: Column, s: Substitution) -> Column:
    return F.regexp_replace(c, to_java(s.pattern, ignore_case=True), s.replacement)


def cleanup_spacing(c: Column, original: Column) -> Column:
    r = F.regexp_replace(c, " {2,}", " ")
    r = F.regexp_replace(r, f"{WS}+([.,!?;:])", "$1")
    r = F.regexp_replace(r, "[ \t]+\n", "\n")
    r = F.regexp_replace(r, "\n{3,}", "\n\n")
    r = js_trim(r)
    orig_first = F.substring(js_trim(original), 1, 1)
    first = F.substring(r, 1, 1)
    recap = orig_first.rlike("^[A-Z]$") & first.rlike("^[a-z]$")
    return F.when(recap, F.concat(F.upper(first), F.substring(r, 2, 1 << 30))).otherwise(r)


def structural_issues(original: Column) -> Column:
    t = js_trim(original)
    first_word = F.lower(F.regexp_extract(t, r"^\w+", 0))
    verbs = F.array(*[F.lit(v) for v in TASK_VERBS])
    opener = t.rlike(to_java(r"^(can|could|would|will|is|do|are|i)\b", ignore_case=True))
    task = ((F.length(first_word) > 0) & ~F.array_contains(verbs, first_word) & opener & (F.length(t) > 30))
    fmt = (F.length(t) > 120) & ~t.rlike("(?i)(format|json|list|bullet|table|paragraph|markdown|csv|yaml|xml)")

    def issue(spec):
        return F.struct(F.lit(spec[0]).alias("type"), F.lit(spec[1]).alias("description"),
                        F.lit(spec[2]).alias("suggestion"))

    return F.filter(F.array(F.when(task, issue(ISSUE_TASK_VERB)), F.when(fmt, issue(ISSUE_FORMAT))),
                    lambda x: x.isNotNull())


def optimize_prompt(df: DataFrame, text_col: str = "text", token_counter=approx_tokens) -> DataFrame:
    """Adds the optimisation result columns to ``df``.

    Columns: should_suggest, optimized_text, optimizations ARRAY<STRUCT<type,
    description, before, after>>, structural_issues, original_tokens,
    optimized_tokens, tokens_saved, percent_saved, reason.
    """
    t = F.col(text_col)
    # stage 1: every intermediate of the substitution chain
    inter = [t]
    for s in SUBSTITUTIONS:
        inter.append(_sub(inter[-1], s))
    stage_cols = [c.alias(f"_i{k}") for k, c in enumerate(inter[1:], start=1)]
    staged = df.select("*", *stage_cols)
    # stage 2: per-step match log on the intermediate each step ran on
    logs = []
    for k, s in enumerate(SUBSTITUTIONS):
        src = t if k == 0 else F.col(f"_i{k}")
        ms = F.regexp_extract_all(src, F.lit(to_java(s.pattern, ignore_case=True)), 0)
        logs.append(F.transform(ms, _log_entry(s)))
    final = F.col(f"_i{len(SUBSTITUTIONS)}")
    optimized = cleanup_spacing(final, t)
    orig_tokens = token_counter(t)
    staged = staged.select(*df.columns, F.flatten(F.array(*logs)).alias("_log"),
                           optimized.alias("_opt"), orig_tokens.alias("_ot"))
    opt_tokens = token_counter(F.col("_opt"))
    saved = F.col("_ot") - opt_tokens
    pct = F.when(F.col("_ot") == 0, F.lit(0.0)).otherwise(F.floor(saved / F.col("_ot") * 10000 + 0.5) / 100)
    issues = structural_issues(t)
    short = F.col("_ot") < 10
    suggest = (((saved >= 5) & (pct >= 10)) | (F.size(issues) > 0) | (F.size("_log") >= 3))
    empty_log = F.array().cast("array<struct<type:string,description:string,before:string,after:string>>")
    empty_iss = F.array().cast("array<struct<type:string,description:string,suggestion:string>>")
    out = staged.select(
        *df.columns,
        F.when(short, F.lit(False)).otherwise(suggest).alias("should_suggest"),
        F.when(short, t).otherwise(F.col("_opt")).alias("optimized_text"),
        F.when(short, empty_log).otherwise(F.col("_log")).alias("optimizations"),
        F.when(short, empty_iss).otherwise(issues).alias("structural_issues"),
        F.col("_ot").alias("original_tokens"),
        F.when(short, F.col("_ot")).otherwise(opt_tokens).alias("optimized_tokens"),
        F.when(short, F.lit(0)).otherwise(saved).alias("tokens_saved"),
        F.when(short, F.lit(0.0)).otherwise(pct).cast("double").alias("percent_saved"),
        F.when(short, F.lit(REASON_SHORT)).when(~suggest, F.lit(REASON_CONCISE)).alias("reason"),
    )
    return out


def _log_entry(s: Substitution):
    def entry(m):
        return F.struct(F.lit(s.category).alias("type"), F.lit(s.description).alias("description"),
                        m.alias("before"), F.lit(s.replacement).alias("after"))
    return entry


# ---------------------------------------------------------------------------
# Compression levels (phrase lists are ours; see README "compression")
# ---------------------------------------------------------------------------

LEVELS = ["light", "medium", "aggressive", "caveman"]

# light: obvious filler and verbose phrases (the first 14 substitutions)
_LIGHT = [(s.pattern, s.replacement) for s in SUBSTITUTIONS[:14]]
# medium: + meta-commentary, hedges and connector adverbs
_MEDIUM = [
    (r"\bI was wondering (if|whether)( you (could|can|would))?\s*", ""),
    (r"\bI (think|believe|guess|suppose)( that)? (it (would|might) be (great|good|nice|helpful) if you (could|can)\s*)?", ""),
    (r"\bI (really |truly )?appreciate (it|that|this|your help)[!.]?\s*", ""),
    (r"\bthanks( so much)?( in advance)?[,!.]?\s*", ""),
    (SUBSTITUTIONS[14].pattern, ""),
    (SUBSTITUTIONS[15].pattern, ""),
    (r"\b(just|basically|actually|really|simply|literally|essentially) ", ""),
    (r"\b(kind of|sort of) ", ""),
]
# aggressive: + articles after task verbs, restated-question openers
_AGGRESSIVE = [
    (r"\b(write|create|generate|explain|describe|list|show|build|give|make|find|summarize|draft) (a|an|the) ", "$1 "),
    (r"\b(my question is|the question is|what I want to know is)[:,]?\s*", ""),
]
# caveman: + every article
_CAVEMAN = [(r"\b(the|a|an)\b ?", "")]

LEVEL_RULES = {
    "light": _LIGHT,
    "medium": _LIGHT + _MEDIUM,
    "aggressive": _LIGHT + _MEDIUM + _AGGRESSIVE,
    "caveman": _LIGHT + _MEDIUM + _AGGRESSIVE + _CAVEMAN,
}

# Per-level warnings.
WARNINGS = {
    "light": "Light compression is conservative: only obvious filler was removed.",
    "medium": "Medium compression removes filler and hedging and tries to preserve meaning.",
    "aggressive": "Aggressive compression may reduce quality; review the result before sending.",
    "caveman": "Caveman compression strips all articles; the result is telegraphic and may change meaning.",
}

FENCE = r"```[\s\S]*?```"


def _substituted(c: Column, rules) -> Column:
    for pat, rep in rules:
        c = F.regexp_replace(c, to_java(pat, ignore_case=True), rep)
    return c


def _segments(text: Column) -> Column:
    """The parts of the text between fenced code blocks."""
    return F.split(text, to_java(FENCE), -1)


def _joined(text: Column, segments: Column) -> Column:
    """Substituted segments tidied and put around the untouched fenced code blocks."""
    def tidy(c):
        return F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"[ \t]+([.,!?;:])", "$1")

    fences = F.regexp_extract_all(text, F.lit("(" + to_java(FENCE) + ")"), 1)
    joined = F.array_join(F.zip_with(F.transform(segments, tidy), fences,
                                     lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), "")
    r = F.regexp_replace(joined, "\n{3,}", "\n\n")
    r = js_trim(r)
    orig_first = F.substring(js_trim(text), 1, 1)
    first = F.substring(r, 1, 1)
    recap = orig_first.rlike("^[A-Z]$") & first.rlike("^[a-z]$")
    return F.when(recap, F.concat(F.upper(first), F.substring(r, 2, 1 << 30))).otherwise(r)


def compress_text(text: Column, level: str) -> Column:
    """Compress non-fenced segments at ``level``; fenced code blocks untouched."""
    return _joined(text, F.transform(_segments(text), lambda p: _substituted(p, LEVEL_RULES[level])))


def compress_prompt(df: DataFrame, text_col: str = "text", level: str = "medium",
                    token_counter=approx_tokens) -> DataFrame:
    t = F.col(text_col)
    staged = df.select("*", compress_text(t, level).alias("compressed_text"))
    ot, ct = token_counter(t), token_counter(F.col("compressed_text"))
    saved = ot - ct
    return staged.select(
        *df.columns, F.lit(level).alias("level"), ot.alias("original_tokens"), ct.alias("compressed_tokens"),
        saved.alias("tokens_saved"),
        F.when(ot == 0, F.lit(0.0)).otherwise(F.floor(saved / ot * 10000 + 0.5) / 100).cast("double").alias("percent_saved"),
        "compressed_text", F.lit(WARNINGS[level]).alias("warning"),
        F.size(F.regexp_extract_all(t, F.lit("(" + to_java(FENCE) + ")"), 1)).alias("preserved_code_blocks"))


def compress_levels(df: DataFrame, text_col: str = "text", token_counter=approx_tokens) -> DataFrame:
    """One row for each level and input row, from one pass over the rows."""
    t = F.col(text_col)
    # a level's rules begin with those of the level before: each level goes on from that one's segments
    staged, segments, done = df, _segments(t), 0
    for lv in LEVELS:
        rules = LEVEL_RULES[lv][done:]
        staged = staged.withColumn(f"_s_{lv}", F.transform(segments, lambda p: _substituted(p, rules)))
        segments, done = F.col(f"_s_{lv}"), len(LEVEL_RULES[lv])
    staged = staged.select(*df.columns, *[_joined(t, F.col(f"_s_{lv}")).alias(f"_{lv}") for lv in LEVELS])
    rows = staged.select(*df.columns, F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.col(f"_{lv}").alias("compressed_text"), F.lit(WARNINGS[lv]).alias("warning"))
        for lv in LEVELS])).alias("_c")).select(*df.columns, "_c.*")
    ot, ct = token_counter(t), token_counter(F.col("compressed_text"))
    saved = ot - ct
    return rows.select(
        *df.columns, "level", ot.alias("original_tokens"), ct.alias("compressed_tokens"), saved.alias("tokens_saved"),
        F.when(ot == 0, F.lit(0.0)).otherwise(F.floor(saved / ot * 10000 + 0.5) / 100).cast("double").alias("percent_saved"),
        "compressed_text", "warning", F.size(F.regexp_extract_all(t, F.lit("(" + to_java(FENCE) + ")"), 1)).alias("preserved_code_blocks"))


# Compression flags (checked in order): the caveman flag, then the medium
# flag words. Further alias words can be passed by the caller.
CAVEMAN_FLAGS = ("pg!",)
MEDIUM_FLAGS = ("pg",)


def flag_pattern(words) -> str:
    return r"^\s*(?:" + "|".join(re.escape(w) for w in words) + r")\s+"


FLAG_CAVEMAN = flag_pattern(CAVEMAN_FLAGS)
FLAG_MEDIUM = flag_pattern(MEDIUM_FLAGS)


def parse_compress_flag(text: Column, caveman_flags=CAVEMAN_FLAGS, medium_flags=MEDIUM_FLAGS) -> Column:
    """STRUCT<level, body, flag> or NULL when the text carries no flag."""
    cav = to_java(flag_pattern(caveman_flags), ignore_case=True)
    med = to_java(flag_pattern(medium_flags), ignore_case=True)
    m_cav = F.regexp_extract(text, cav, 0)
    m_med = F.regexp_extract(text, med, 0)
    is_cav = text.rlike(cav)
    is_med = text.rlike(med)
    m = F.when(is_cav, m_cav).otherwise(m_med)
    st = F.struct(F.when(is_cav, F.lit("caveman")).otherwise(F.lit("medium")).alias("level"),
                  F.substring(text, F.length(m) + 1, 1 << 30).alias("body"),
                  js_trim(m).alias("flag"))
    return F.when(is_cav | is_med, st)


def compress_for_send(df: DataFrame, text_col: str = "text", token_counter=approx_tokens) -> DataFrame:
    """Adds ``flag`` (struct or NULL) and ``outcome`` STRUCT<level, sent_text, original_body,
    tokens_saved, percent_saved> (NULL without a flag or with a blank body)."""
    t = F.col(text_col)
    staged = df.withColumn("flag", parse_compress_flag(t))
    body = F.col("flag.body")
    sent = (F.when(F.col("flag.level") == "caveman", compress_text(body, "caveman"))
             .otherwise(compress_text(body, "medium")))
    staged = staged.withColumn("_sent", sent)
    ot, ct = token_counter(body), token_counter(F.col("_sent"))
    saved = ot - ct
    outcome = F.struct(F.col("flag.level").alias("level"), F.col("_sent").alias("sent_text"),
                       body.alias("original_body"), saved.alias("tokens_saved"),
                       F.when(ot == 0, F.lit(0.0)).otherwise(F.floor(saved / ot * 10000 + 0.5) / 100)
                       .cast("double").alias("percent_saved"))
    blank = F.length(js_trim(body)) == 0
    return staged.withColumn("outcome", F.when(F.col("flag").isNotNull() & ~blank, outcome)).drop("_sent")
