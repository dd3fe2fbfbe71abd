"""Regex dialect rewriting and match-with-offset column expressions.

Rules are written in the portable dialect (ASCII ``\\b``, wide ``\\s``, ``$`` =
end of input). Java's ``\\b`` is Unicode-aware on Java 17 and its ``\\s`` is
ASCII-only; RE2's ``\\s`` lacks ``\\v`` and the Unicode spaces. ``to_java`` and
``to_re2`` rewrite those three tokens so both engines see the same language.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace set of the portable dialect (``\s``), as a class body.
JS_WS_CLASS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = "A-Za-z0-9_"
ASCII_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


_WORD_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


def _class_is_word_only(body: str) -> bool:
    """True when a (non-negated) class body only admits ASCII word chars."""
    if body.startswith("^") or not body:
        return False
    groups = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
    i = 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if body[i + 1:i + 2] != "d":
                return False
            i += 2
            continue
        if c not in _WORD_CHARS:
            return False
        if i + 2 < len(body) and body[i + 1] == "-":
            hi = body[i + 2]
            if not any(c in g and hi in g and g.index(c) <= g.index(hi) for g in groups):
                return False
            i += 3
            continue
        i += 1
    return True


def _atom_at(pattern: str, i: int) -> tuple[bool, int]:
    """(is a word-only atom, index after atom) for the atom starting at i."""
    n = len(pattern)
    if i >= n:
        return False, i
    c = pattern[i]
    if c == "\\":
        return pattern[i + 1:i + 2] == "d", i + 2
    if c == "[":
        j = i + 1
        if j < n and pattern[j] == "^":
            j += 1
        while j < n and pattern[j] != "]":
            j += 2 if pattern[j] == "\\" else 1
        return _class_is_word_only(pattern[i + 1:j]), j + 1
    return c in _WORD_CHARS, i + 1


def _mandatory_quant(pattern: str, j: int) -> bool:
    """The quantifier at j (if any) requires at least one repetition."""
    if j >= len(pattern):
        return True
    q = pattern[j]
    if q in "?*":
        return False
    if q == "{":
        return not pattern[j + 1:].startswith("0")
    return True


def _rewrite(pattern: str, boundary: str | None, end_anchor: str) -> str:
    out: list[str] = []
    i, n = 0, len(pattern)
    in_class = False
    prev_word = False   # last complete atom surely ended on a word char
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(JS_WS_CLASS if in_class else f"[{JS_WS_CLASS}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{JS_WS_CLASS}]")
            elif nxt == "b" and not in_class and boundary is not None:
                nxt_word, after = _atom_at(pattern, i + 2)
                follows_end = pattern[i + 2:i + 3] in ("", "|", ")") or pattern.startswith("(?!", i + 2)
                if nxt_word and _mandatory_quant(pattern, after):
                    out.append(f"(?<![{WORD}])")
                elif prev_word and follows_end:
                    out.append(f"(?![{WORD}])")
                else:
                    out.append(boundary)
            elif nxt == "/":
                out.append("/")
            else:
                out.append(c + nxt)
            if not in_class and nxt != "b":
                prev_word = nxt == "d" and _mandatory_quant(pattern, i + 2)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                prev_word = (_class_is_word_only(_source_body(pattern, i))
                             and _mandatory_quant(pattern, i + 1))
            out.append(c)
        elif c == "[":
            in_class = True
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("[^")
                i += 2
                continue
            out.append(c)
        elif c == "$":
            out.append(end_anchor)
            prev_word = False
        elif c == "{":
            j = pattern.index("}", i)
            out.append(pattern[i:j + 1])
            i = j + 1
            continue
        elif c in "+*?":
            out.append(c)
            if c in "*?":
                prev_word = False
        else:
            out.append(c)
            prev_word = c in _WORD_CHARS and _mandatory_quant(pattern, i + 1)
        i += 1
    return "".join(out)


def _source_body(pattern: str, close_idx: int) -> str:
    """Body of the class that closes at ``close_idx`` in the source pattern."""
    j = close_idx - 1
    while j >= 0:
        if pattern[j] == "[" and (j == 0 or pattern[j - 1] != "\\"):
            break
        j -= 1
    return pattern[j + 1:close_idx]


def to_java(pattern: str, ignore_case: bool = False) -> str:
    p = _rewrite(pattern, ASCII_BOUNDARY, r"\z")
    # Java's \w is that same ASCII class, looked up in a table; under (?i) the spelled one compares case by case
    p = re.sub(rf"(\(\?<?[=!])\[{WORD}\]\)", r"\1\\w)", p)
    return ("(?i)" + p) if ignore_case else p


def to_re2(pattern: str, ignore_case: bool = False) -> str:
    """RE2 dialect for the DuckDB oracle (RE2 ``\\b`` is already ASCII)."""
    p = _rewrite(pattern, None, r"\z")
    return ("(?i)" + p) if ignore_case else p


def sql_str(s: str) -> str:
    """Quote a Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def duck_str(s: str) -> str:
    """Quote a Python string as a DuckDB (standard SQL) string literal."""
    return "'" + s.replace("'", "''") + "'"


def matches_with_offsets(text: Column | str, java_pattern: str) -> Column:
    """All non-overlapping matches of ``java_pattern`` with code-point offsets.

    Returns ``ARRAY<STRUCT<s INT, e INT, m STRING>>`` (half-open ``[s, e)``).
    Two passes of the same pattern: ``regexp_extract_all`` gives the matches,
    ``split`` the gaps between them; the start of match *i* is the length of
    everything before it. Requires a pattern that never matches empty.
    """
    t = F.col(text) if isinstance(text, str) else text
    wrapped = "(" + java_pattern + ")"
    hits = F.regexp_extract_all(t, F.lit(wrapped), 1)
    gaps = F.transform(F.split(t, java_pattern, -1), lambda p: F.length(p))
    return _offsets(hits, gaps)


def raw_matches(text: Column, java_pattern: str) -> Column:
    """Stage 1 of ``matches_with_offsets``: the match strings only."""
    return F.regexp_extract_all(text, F.lit("(" + java_pattern + ")"), 1)


def _offsets(hits: Column, gaps: Column) -> Column:
    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), hits,
                       lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    init = F.struct(F.lit(0).alias("pos"),
                    F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc, z):
        s = acc["pos"] + z["g"]
        e = s + F.length(z["m"])
        return F.struct(e.alias("pos"),
                        F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), z["m"].alias("m"))).alias("out"))

    folded = F.aggregate(F.filter(pairs, lambda z: z["m"].isNotNull()), init, step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, folded).otherwise(
        F.array().cast("array<struct<s:int,e:int,m:string>>"))


def explode_rows(c):
    """``explode`` without Catalyst's inferred ``size(c) > 0`` pre-filter.

    A plain explode makes the optimizer add that filter below the projection
    that builds ``c``, so an expensive array (a regex scan, a JSON walk) would
    be computed twice. Use with ``.where(<alias>.isNotNull())``.
    """
    return F.explode_outer(c)


# ---------------------------------------------------------------------------
# SQL-text forms. Building higher-order functions from Python lambdas costs
# many Py4J round trips per lambda; the same expressions written as Spark SQL
# text are parsed once on the JVM (one call per expression).
# ---------------------------------------------------------------------------

OFFSET_TYPE = "array<struct<s:int,e:int,m:string>>"


def q_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bind_sql(name: str, value: str, body: str) -> str:
    """``body`` with the lambda variable ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Entries that one inner fold handles: appending to an array copies it, so a
#: long fold runs over blocks and copies a block, not everything before it.
FOLD_BLOCK = 128


def blocks_sql(array: str) -> str:
    return (f"transform(sequence(0, CAST((size({array}) - 1) DIV {FOLD_BLOCK} AS INT)), "
            f"i -> slice({array}, i * {FOLD_BLOCK} + 1, {FOLD_BLOCK}))")


def offsets_sql(text_sql: str, hits_sql: str, java_pattern: str) -> str:
    """SQL for the offsets of precomputed match strings ``hits_sql`` in ``text_sql``
    (gaps from a ``split`` of the same pattern; run only when there are hits).

    Block starts come from a fold over the blocks' lengths, offsets from a fold
    inside each block.
    """
    gaps = f"transform(split({text_sql}, {sql_str(java_pattern)}, -1), p -> length(p))"
    pairs = f"zip_with(slice({gaps}, 1, size({hits_sql})), {hits_sql}, (g, mm) -> named_struct('g', g, 'm', mm))"
    step = ("(acc, z) -> named_struct('pos', acc.pos + z.g + length(z.m), 'out', array_append(acc.out, "
            "named_struct('s', acc.pos + z.g, 'e', acc.pos + z.g + length(z.m), 'm', z.m)))")
    starts = ("aggregate(bl, named_struct('pos', 0, 'out', CAST(array() AS array<int>)), (a, b) -> named_struct("
              "'pos', a.pos + aggregate(b, 0, (n, z) -> n + z.g + length(z.m)), 'out', array_append(a.out, a.pos)), a -> a.out)")
    inside = (f"flatten(zip_with(bl, {starts}, (b, st) -> aggregate(b, named_struct('pos', st, 'out', "
              f"CAST(array() AS {OFFSET_TYPE})), {step}, acc -> acc.out)))")
    whole = bind_sql("pairs", pairs, bind_sql("bl", blocks_sql("pairs"), inside))
    return f"CASE WHEN size({hits_sql}) > 0 THEN {whole} ELSE CAST(array() AS {OFFSET_TYPE}) END"


def runs_sql(rows: str, key: str, wrap) -> str:
    """SQL: ``wrap(rows, first, size)`` of each run of equal ``key`` in an array sorted by it; linear in the array."""
    starts = "filter(sequence(0, size(sr) - 1), j -> j = 0 OR sr[j].{k} <> sr[j - 1].{k})".format(k=key)
    each = f"transform(st, (f, q) -> {wrap('sr', 'f', '(coalesce(get(st, q + 1), size(sr)) - f)')})"
    # no rows: a sequence would run backwards
    made = bind_sql("st", f"CASE WHEN size(sr) > 0 THEN {starts} ELSE CAST(array() AS array<int>) END", each)
    return bind_sql("sr", rows, made)
