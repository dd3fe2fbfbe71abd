"""Checksum validators as Column expressions (no Python UDF).

They run on the exploded ``matched`` column, i.e. only on regex candidates.
Digits are read with ``ascii(substring(..)) - 48`` so no cast can fail under
ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import JS_WS_CLASS

# Verhoeff dihedral-group multiplication table D and permutation
# table P (the standard published tables).
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, f"[{JS_WS_CLASS}-]", "")


def _digit(d: Column, i: Column) -> Column:
    return F.ascii(F.substring(d, i, 1)) - F.lit(48)


def luhn_ok(c: Column) -> Column:
    """Luhn check on the separator-stripped value (13 to 19 digits)."""
    d = strip_separators(c)
    n = F.length(d)

    def step(acc, i):
        x = F.ascii(F.substring(d, i, 1)) - 48
        from_right = n - i  # 0 for the last digit
        doubled = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(from_right % 2 == 1, doubled).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)
    return (n >= 13) & (n <= 19) & d.rlike("^[0-9]+$") & (total % 10 == 0)


def card_ok(c: Column) -> Column:
    """Real card: network length, Luhn and a known issuer prefix."""
    d = strip_separators(c)
    n = F.length(d)
    p2 = F.try_to_number(F.substring(d, 1, 2), F.lit("99"))
    p3 = F.try_to_number(F.substring(d, 1, 3), F.lit("999"))
    p4 = F.try_to_number(F.substring(d, 1, 4), F.lit("9999"))
    starts = lambda s: d.startswith(s)
    visa = starts("4") & n.isin(13, 16, 19)
    master = (p2.between(51, 55) | p4.between(2221, 2720)) & (n == 16)
    amex = (starts("34") | starts("37")) & (n == 15)
    discover = (starts("6011") | (p2 == 65) | p3.between(644, 649)) & n.isin(16, 19)
    diners = (p3.between(300, 305) | starts("36") | starts("38") | starts("39")) & (n == 14)
    jcb = p4.between(3528, 3589) & n.between(16, 19)
    unionpay = starts("62") & n.between(16, 19)
    network = visa | master | amex | discover | diners | jcb | unionpay
    return (d.rlike("^[0-9]+$") & n.isin(13, 14, 15, 16, 19) & luhn_ok(d)
            & F.coalesce(network, F.lit(False)))


def verhoeff_ok(c: Column) -> Column:
    """Aadhaar: 12 digits, first 2-9, Verhoeff checksum over the digits."""
    d = strip_separators(c)
    table_d = F.array(*[F.array(*[F.lit(v) for v in row]) for row in VERHOEFF_D])
    table_p = F.array(*[F.array(*[F.lit(v) for v in row]) for row in VERHOEFF_P])

    def step(acc, i):
        # i = 0 is the last digit (the check digit)
        x = F.ascii(F.substring(d, F.lit(12) - i, 1)) - 48
        return F.try_element_at(F.try_element_at(table_d, acc + 1),
                            F.try_element_at(F.try_element_at(table_p, (i % 8) + 1), x + 1) + 1)

    c_final = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step)
    ok_shape = d.rlike("^[2-9][0-9]{11}$")
    return ok_shape & F.when(ok_shape, c_final == 0).otherwise(F.lit(False))


# ---------------------------------------------------------------------------
# The same validators as Spark SQL text (for expressions built as SQL).
# ---------------------------------------------------------------------------

def _strip_sql(m: str) -> str:
    from veilscan.functions.regex import sql_str
    return f"regexp_replace({m}, {sql_str('[' + JS_WS_CLASS + '-]')}, '')"


def luhn_ok_sql(m: str) -> str:
    d = _strip_sql(m)
    n = f"length({d})"
    x = f"(ascii(substring({d}, i, 1)) - 48)"
    total = (f"aggregate(sequence(1, greatest({n}, 1)), 0, (acc, i) -> acc + CASE WHEN ({n} - i) % 2 = 1 "
             f"THEN (CASE WHEN {x} * 2 > 9 THEN {x} * 2 - 9 ELSE {x} * 2 END) ELSE {x} END)")
    return f"({n} >= 13 AND {n} <= 19 AND {d} RLIKE '^[0-9]+$' AND {total} % 10 = 0)"


def card_ok_sql(m: str) -> str:
    d = _strip_sql(m)
    n = f"length({d})"
    p2, p3, p4 = (f"try_cast(substring({d}, 1, {k}) AS INT)" for k in (2, 3, 4))
    sw = lambda s: f"startswith({d}, '{s}')"
    network = (f"(({sw('4')} AND {n} IN (13, 16, 19)) OR "
               f"((({p2} BETWEEN 51 AND 55) OR ({p4} BETWEEN 2221 AND 2720)) AND {n} = 16) OR "
               f"(({sw('34')} OR {sw('37')}) AND {n} = 15) OR "
               f"(({sw('6011')} OR {p2} = 65 OR ({p3} BETWEEN 644 AND 649)) AND {n} IN (16, 19)) OR "
               f"((({p3} BETWEEN 300 AND 305) OR {sw('36')} OR {sw('38')} OR {sw('39')}) AND {n} = 14) OR "
               f"(({p4} BETWEEN 3528 AND 3589) AND {n} BETWEEN 16 AND 19) OR "
               f"({sw('62')} AND {n} BETWEEN 16 AND 19))")
    return (f"({d} RLIKE '^[0-9]+$' AND {n} IN (13, 14, 15, 16, 19) AND {luhn_ok_sql(m)} "
            f"AND coalesce({network}, false))")


def verhoeff_ok_sql(m: str) -> str:
    d = _strip_sql(m)
    td = "array(" + ", ".join("array(" + ", ".join(map(str, r)) + ")" for r in VERHOEFF_D) + ")"
    tp = "array(" + ", ".join("array(" + ", ".join(map(str, r)) + ")" for r in VERHOEFF_P) + ")"
    x = f"(ascii(substring({d}, 12 - i, 1)) - 48)"
    fold = (f"aggregate(sequence(0, 11), 0, (c, i) -> try_element_at(try_element_at({td}, c + 1), "
            f"try_element_at(try_element_at({tp}, (i % 8) + 1), {x} + 1) + 1))")
    ok_shape = f"({d} RLIKE '^[2-9][0-9]{{11}}$')"
    return f"({ok_shape} AND CASE WHEN {ok_shape} THEN {fold} = 0 ELSE false END)"
