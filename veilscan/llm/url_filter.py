"""URL filter: rules first, then exact list membership by a Bloom filter cascade.

Level 1 encodes the listed keys. Keys of the universe that are not listed but
pass level 1 (its false positives) are encoded by level 2, the listed keys that
pass level 2 by level 3, and so on until a level has no false positive over
the universe. A key of the universe is then decided by the first level it
fails: an odd level says "not listed", an even one "listed". A key that passes
every level belongs to the set that the last level encodes.

Everything is DataFrame expressions: bit positions come from ``xxhash64``, bits
are packed with ``bit_or`` into arrays of longs, and a lookup is ``get`` on those
arrays, so the page table is read once and never joined with the list. The
filter is cut into segments by key hash, each of a bounded size; one segment
reaches the tasks as a scalar subquery. A filter of several segments is too
large for that and each page row meets its segment's arrays by segment number.

Defined cases: a null url, or one without ``://``, has empty host and path; its
key is the empty string. An empty universe or list gives a cascade of zero
levels: nothing is listed. Repeated rows are judged alike. Extra columns are
ignored by ``judge_pages`` except the id and url columns named.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stage

#: Listed keys for each segment: a segment's arrays stay below about 1 MB in all.
SEGMENT_KEYS = 200_000
MAX_LEVELS = 64


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
    return own & F.startswith(path, F.lit(rule.path))


def first_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        hit = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(_fits(rule, host, path), hit).otherwise(out)
    return out


class Cascade(NamedTuple):
    """levels: (bits, hashes) of each level; table: seg int, words array<array<bigint>> by level."""

    segments: int
    levels: list[tuple[int, int]]
    table: DataFrame | None


def _key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _segment(a: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(a, F.lit("segment")), F.lit(segments)).cast("int")


def _position(a: Column, b: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(a, b, F.lit(level * 64 + i)), F.lit(bits))


def _passes(words: Column, a: Column, b: Column, level: int, shape: tuple[int, int]) -> Column:
    """Does the key pass level ``level`` (0-based), whose arrays are ``words[level]``?"""
    bits, hashes = shape
    out = F.lit(True)
    for i in range(hashes):
        pos = _position(a, b, level, i, bits)
        word = F.get(F.get(words, F.lit(level)), F.shiftright(pos, 6).cast("int"))
        # a segment in which a level encodes no key has no array: nothing passes
        out = out & (F.coalesce(word.bitwiseAND(_bit(pos)), F.lit(0)) != 0)
    return out


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(pos, F.lit(64)).cast("int"))


def _listed(words: Column, a: Column, b: Column, levels: list[tuple[int, int]]) -> Column:
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        out = F.when(_passes(words, a, b, level, levels[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def _shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits (whole words) and hash count of one segment's filter for ``keys`` keys."""
    need = max(1.0, -math.log(rate)) / math.log(2) ** 2 * max(keys, 1)
    return 64 * math.ceil(need / 64), max(1, round(-math.log2(rate)))


def build_cascade(universe: DataFrame, key: str, listed: str, segment_keys: int = SEGMENT_KEYS) -> Cascade:
    """Cascade over ``universe``: a key is listed if any of its rows has ``listed`` true."""
    a, b = _key_hashes(F.coalesce(F.col(key), F.lit("")))
    keys = stage(
        universe.groupBy(a.alias("a"), b.alias("b")).agg(F.max(F.coalesce(F.col(listed), F.lit(False))).alias("listed")), "keys"
    )
    n_in, n_all = keys.agg(F.coalesce(F.sum(F.col("listed").cast("bigint")), F.lit(0)), F.count("*")).first()
    if not n_in:
        return Cascade(1, [], None)
    segments = max(1, math.ceil(n_in / segment_keys))
    keys = keys.withColumn("seg", _segment(F.col("a"), segments))
    rate = min(0.5, max(1e-6, n_in * math.sqrt(0.5) / max(1, n_all - n_in)))
    levels: list[tuple[int, int]] = []
    table: DataFrame | None = None
    inside = n_in
    while inside:
        if len(levels) >= MAX_LEVELS:
            raise ValueError("two keys share a 128-bit hash: the cascade cannot tell them apart")
        level, odd = len(levels), len(levels) % 2 == 0
        shape = _shape(math.ceil(inside / segments * (1.2 if segments > 1 else 1)), rate if level == 0 else 0.1)
        alive = keys.where(F.col("listed") == F.lit(odd))
        if level:
            alive = _with_words(alive, table, segments)
            for n in range(odd, level, 2):  # the levels that encode the other side
                alive = alive.where(_passes(F.col("words"), F.col("a"), F.col("b"), n, levels[n]))
        built = _level_arrays(alive, level, shape)
        levels.append(shape)
        table = stage(built if table is None else _append(table, built), f"level{level}")
        tested = _with_words(keys.where(F.col("listed") != F.lit(odd)), table, segments)
        for n in range(not odd, level, 2):
            tested = tested.where(_passes(F.col("words"), F.col("a"), F.col("b"), n, levels[n]))
        inside = tested.where(_passes(F.col("words"), F.col("a"), F.col("b"), level, shape)).count()
    return Cascade(segments, levels, table)


def _level_arrays(alive: DataFrame, level: int, shape: tuple[int, int]) -> DataFrame:
    bits, hashes = shape
    pos = F.array(*[_position(F.col("a"), F.col("b"), level, i, bits) for i in range(hashes)])
    rows = alive.select("seg", F.explode(pos).alias("pos"))
    packed = rows.groupBy("seg", F.shiftright("pos", 6).cast("bigint").alias("w")).agg(F.bit_or(_bit(F.col("pos"))).alias("bits"))
    blank = alive.select("seg").distinct().select("seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bits // 64 - 1).cast("bigint"))).alias("w"), F.lit(0).cast("bigint").alias("bits"))
    dense = packed.unionByName(blank).groupBy("seg", "w").agg(F.bit_or("bits").alias("bits"))
    one = F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"])
    return dense.groupBy("seg").agg(F.array(one).alias("words"))


def _append(table: DataFrame, built: DataFrame) -> DataFrame:
    """One row a segment; a segment without keys at this level gets a null array there."""
    none = F.array(F.lit(None).cast("array<bigint>"))
    both = table.withColumnRenamed("words", "old").join(built.withColumnRenamed("words", "new"), "seg", "full")
    depth = table.select(F.max(F.size("words"))).first()[0]
    old = F.coalesce(F.col("old"), F.array_repeat(F.lit(None).cast("array<bigint>"), depth))
    return both.select("seg", F.concat(old, F.coalesce(F.col("new"), none)).alias("words"))


def _with_words(rows: DataFrame, table: DataFrame, segments: int) -> DataFrame:
    if segments == 1:
        return rows.withColumn("words", table.select("words").scalar())
    return rows.join(table, "seg", "left")


def in_list(rows: DataFrame, key: Column, cascade: Cascade, out: str) -> DataFrame:
    """Add boolean ``out``: is the key (one of the universe) listed?"""
    if not cascade.levels:
        return rows.withColumn(out, F.lit(False))
    a, b = _key_hashes(F.coalesce(key, F.lit("")))
    own = rows.columns
    rows = rows.withColumns({"_a": a, "_b": b})
    rows = rows.withColumn("seg", _segment(F.col("_a"), cascade.segments))
    rows = _with_words(rows, cascade.table, cascade.segments)
    return rows.withColumn(out, _listed(F.col("words"), F.col("_a"), F.col("_b"), cascade.levels)).select(*own, out)


def judge_pages(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed: the longest fitting rule decides, else the list.

    The list holds the addresses (host and path) that the table ever reaches
    over plain ``http``; addresses only seen over other schemes are allowed.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), F.coalesce(F.startswith(lower_ascii(url), F.lit("http://")), F.lit(False)).alias("plain"))
    rows = rows.withColumn("key", F.concat("host", "path"))
    cascade = build_cascade(rows, "key", "plain")
    ruled = first_rule(rules, F.col("host"), F.col("path"))
    judged = in_list(rows, F.col("key"), cascade, "listed").withColumn("hit", ruled)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "listed")
