"""SQL oracle builders (DuckDB dialect) for the correctness gate.

These generate independent SQL for what the Spark jobs compute, from the same
rule catalogue. RE2 has no lookaround, so the two rules that need it are
extracted with a looser pattern and filtered afterwards.
"""

from __future__ import annotations

from veilscan.functions.regex import JS_WS_CLASS, to_re2
from veilscan.functions.rules import ALL_RULES, RULE_ORD, Rule
from veilscan.functions.validators import VERHOEFF_D, VERHOEFF_P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Rules needing lookaround: (looser RE2 pattern, SQL predicate on `m`)
_LOOSE = {
    "us_ssn": (r"\b\d{3}-\d{2}-\d{4}\b",
               "NOT (m LIKE '000%' OR m LIKE '666%' OR m LIKE '9%' OR substr(m,5,2)='00' OR substr(m,8,4)='0000')"),
    "india_upi_id": (r"\b[A-Za-z0-9._-]+@[a-z]{2,20}\b\.?", "NOT (m LIKE '%.')"),
}


def rule_re2(r: Rule) -> str:
    if r.id in _LOOSE:
        return to_re2(_LOOSE[r.id][0], r.ignore_case)
    return to_re2(r.pattern, r.ignore_case)


def card_ok_sql(m: str) -> str:
    d = f"regexp_replace({m}, '[{JS_WS_CLASS}-]', '', 'g')"
    n = f"length({d})"
    dig = f"try_cast(substr({d}, {n} - k, 1) AS INTEGER)"
    luhn = (f"(list_sum(list_transform(range({n}), lambda k: CASE WHEN k % 2 = 1 THEN "
            f"(CASE WHEN 2*{dig} > 9 THEN 2*{dig} - 9 ELSE 2*{dig} END) ELSE {dig} END)) % 10 = 0)")
    p2 = f"try_cast(substr({d},1,2) AS INTEGER)"
    p3 = f"try_cast(substr({d},1,3) AS INTEGER)"
    p4 = f"try_cast(substr({d},1,4) AS INTEGER)"
    sw = lambda s: f"starts_with({d}, '{s}')"
    network = (f"(({sw('4')} AND {n} IN (13,16,19)) OR "
               f"((({p2} BETWEEN 51 AND 55) OR ({p4} BETWEEN 2221 AND 2720)) AND {n} = 16) OR "
               f"(({sw('34')} OR {sw('37')}) AND {n} = 15) OR "
               f"(({sw('6011')} OR {p2} = 65 OR ({p3} BETWEEN 644 AND 649)) AND {n} IN (16,19)) OR "
               f"((({p3} BETWEEN 300 AND 305) OR {sw('36')} OR {sw('38')} OR {sw('39')}) AND {n} = 14) OR "
               f"(({p4} BETWEEN 3528 AND 3589) AND {n} BETWEEN 16 AND 19) OR "
               f"({sw('62')} AND {n} BETWEEN 16 AND 19))")
    return (f"(regexp_full_match({d}, '[0-9]+') AND {n} IN (13,14,15,16,19) AND coalesce({luhn}, false) "
            f"AND coalesce({network}, false))")


def verhoeff_ok_sql(m: str) -> str:
    d = f"regexp_replace({m}, '[{JS_WS_CLASS}-]', '', 'g')"
    dl = "[" + ",".join("[" + ",".join(map(str, row)) + "]" for row in VERHOEFF_D) + "]"
    pl = "[" + ",".join("[" + ",".join(map(str, row)) + "]" for row in VERHOEFF_P) + "]"
    fold = (f"list_reduce(range(12), lambda c, i: ({dl})[c + 1][({pl})[(i % 8) + 1]"
            f"[try_cast(substr({d}, 12 - i, 1) AS INTEGER) + 1] + 1], 0)")
    return f"(regexp_full_match({d}, '[2-9][0-9]{{11}}') AND coalesce({fold} = 0, false))"


def raw_hits_sql(src: str, id_cols: list[str], text_col: str, rules: list[Rule] | None = None,
                 validate: bool = True) -> str:
    """SQL producing (id_cols, rule_ord, start, "end", m) for every (validated) hit."""
    rules = rules or ALL_RULES
    ids = ", ".join(id_cols)
    branches = []
    for r in rules:
        p = rule_re2(r)
        ordv = RULE_ORD[r.id]
        inner = (f"SELECT {ids}, regexp_extract_all({text_col}, {q('(' + p + ')')}, 1) AS hs, "
                 f"string_split_regex({text_col}, {q(p)}) AS ps FROM {src} WHERE {text_col} IS NOT NULL")
        unn = (f"SELECT {ids}, unnest(list_transform(range(1, len(hs) + 1), lambda i: struct_pack("
               f"m := hs[i], s := coalesce(list_sum(list_transform(ps[1:i], lambda y: length(y))), 0) + "
               f"coalesce(list_sum(list_transform(hs[1:i-1], lambda y: length(y))), 0)))) AS h "
               f"FROM ({inner}) WHERE len(hs) > 0")
        sel = f"SELECT {ids}, {ordv} AS rule_ord, h.s AS start, h.s + length(h.m) AS \"end\", h.m AS m FROM ({unn})"
        conds = []
        if r.id in _LOOSE:
            conds.append(_LOOSE[r.id][1])
            if r.id == "india_upi_id":
                # the looser pattern may have taken a trailing dot; those are dropped entirely
                pass
        if validate and r.validator == "card":
            conds.append(card_ok_sql("m"))
        if validate and r.validator == "verhoeff":
            conds.append(verhoeff_ok_sql("m"))
        where = (" WHERE " + " AND ".join(conds)) if conds else ""
        branches.append(f"SELECT * FROM ({sel}){where}")
    return "\n UNION ALL \n".join(branches)


def rule_meta_sql() -> str:
    rows = ", ".join(
        f"({RULE_ORD[r.id]}, {q(r.id)}, {q(r.name)}, {q(r.severity)}, {r.rank}, {r.confidence}::DOUBLE, {q(r.explanation)})"
        for r in ALL_RULES)
    return (f"(SELECT * FROM (VALUES {rows}) AS rm(rule_ord, rule_id, rule_name, severity, severity_rank, "
            f"confidence, explanation))")


def findings_sql(src: str, id_cols: list[str], text_col: str, rules: list[Rule] | None = None) -> str:
    ids = ", ".join(f"h.{c}" for c in id_cols)
    return (f"SELECT {ids}, rm.rule_id, rm.rule_name, rm.severity, rm.severity_rank, h.start, h.\"end\", "
            f"h.m AS matched, rm.confidence, rm.explanation, h.rule_ord "
            f"FROM ({raw_hits_sql(src, id_cols, text_col, rules)}) h JOIN {rule_meta_sql()} rm USING (rule_ord)")


def luhn_ok_sql(m: str) -> str:
    d = f"regexp_replace({m}, '[{JS_WS_CLASS}-]', '', 'g')"
    n = f"length({d})"
    dig = f"try_cast(substr({d}, {n} - k, 1) AS INTEGER)"
    luhn = (f"(list_sum(list_transform(range({n}), lambda k: CASE WHEN k % 2 = 1 THEN "
            f"(CASE WHEN 2*{dig} > 9 THEN 2*{dig} - 9 ELSE 2*{dig} END) ELSE {dig} END)) % 10 = 0)")
    return f"({n} BETWEEN 13 AND 19 AND regexp_full_match({d}, '[0-9]+') AND coalesce({luhn}, false))"


HIT_STRUCT = "STRUCT(s INTEGER, ne INTEGER, o INTEGER, e INTEGER)"


def kept_spans_sql(hits: str, id_col: str) -> str:
    """Per id: sorted hit list, greedy non-overlapping subset and hit count."""
    return f"""(SELECT {id_col}, count(*) AS n_hits,
  list_reduce(list_sort(list(struct_pack(s := start::INTEGER, ne := (-"end")::INTEGER, o := rule_ord::INTEGER, e := "end"::INTEGER))),
    lambda acc, x: CASE WHEN x.s >= acc.last THEN struct_pack(last := x.e, out := list_append(acc.out, x)) ELSE acc END,
    struct_pack(last := 0, out := []::{HIT_STRUCT}[])).out AS k
  FROM ({hits}) GROUP BY {id_col})"""


def rule_list_sql(attr: str) -> str:
    return "[" + ", ".join(q(str(getattr(r, attr))) for r in ALL_RULES) + "]"


def rebuild_sql(text: str, k: str, wrap: str, gap: str = "{x}") -> str:
    """Rebuild text from kept spans ``k``; ``wrap`` may use {inside}, {sev}, {rid}."""
    prev = f"(CASE WHEN i = 1 THEN 0 ELSE {k}[i-1].e END)"
    inside = f"substr({text}, {k}[i].s + 1, {k}[i].e - {k}[i].s)"
    rid = f"({rule_list_sql('id')})[{k}[i].o + 1]"
    sev = f"({rule_list_sql('severity')})[{k}[i].o + 1]"
    before = gap.format(x=f"substr({text}, {prev} + 1, {k}[i].s - {prev})")
    w = wrap.format(inside=inside, rid=rid, sev=sev)
    body = f"coalesce(array_to_string(list_transform(range(1, len({k}) + 1), lambda i: {before} || {w}), ''), '')"
    tail = gap.format(x=f"substr({text}, coalesce({k}[len({k})].e, 0) + 1)")
    return f"(CASE WHEN {text} IS NULL THEN NULL ELSE {body} || {tail} END)"


def html_escape_sql(x: str) -> str:
    sq = "''''"  # a single quote as a SQL literal
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), {sq}, '&#039;')")


# ---------------------------------------------------------------------------
# Rewriting (DuckDB); `$1` back-references become `\1`
# ---------------------------------------------------------------------------

WS_RE2 = f"[{JS_WS_CLASS}]"


def re2_sub(x: str, pattern: str, repl: str, ignore_case: bool = True) -> str:
    return f"regexp_replace({x}, {q(to_re2(pattern, ignore_case))}, {q(repl.replace('$1', chr(92) + '1'))}, 'g')"


def js_trim_sql(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS_RE2 + '+|' + WS_RE2 + '+' + chr(92) + 'z')}, '', 'g')"


def recap_sql(r: str, original: str) -> str:
    of = f"substr({js_trim_sql(original)}, 1, 1)"
    return (f"(CASE WHEN regexp_full_match({of}, '[A-Z]') AND regexp_full_match(substr({r}, 1, 1), '[a-z]') "
            f"THEN upper(substr({r}, 1, 1)) || substr({r}, 2) ELSE {r} END)")


def cleanup_sql(x: str, original: str) -> str:
    r = f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"
    r = f"regexp_replace({r}, {q(WS_RE2 + '+([.,!?;:])')}, {q(chr(92) + '1')}, 'g')"
    r = f"regexp_replace({r}, '[ \t]+\n', '\n', 'g')"
    r = f"regexp_replace({r}, '\n{{3,}}', '\n\n', 'g')"
    r = js_trim_sql(r)
    return recap_sql(r, original)
