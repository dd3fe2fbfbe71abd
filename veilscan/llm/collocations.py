"""Phrase collocations by SON partitioning.

Documents are dealt to ``SHARDS`` shards by the hash of their id. A phrase that
occurs ``support`` times in all occurs at least support * (words of the shard /
all words) times in one shard, so each shard is mined completely at its
proportionally lowered support and the union of what is frequent somewhere
misses nothing. A shard is mined level by level (words, pairs, then phrases of
three and four words): a phrase is counted only if its parts may be frequent in the shard.
A last pass counts every candidate of the union over all documents, by its own text.

Mining is allowed to find too much, never too little: phrases are counted by
60-bit hashes, and the frequent ones of a level are kept as a Bloom filter of
at most ``FILTER_BITS`` bits, the only thing that is broadcast. What collides or
passes the filter by chance is counted exactly in the last pass and dropped
there. No task holds a shard: tasks combine what they read block by block, and
Spark adds the counts up.

A phrase's words lie in one piece of text (pieces end at ``.,;:!?`` and at line
breaks) and are compared after A-Z are lower-cased. Its score is that of its
worst cut, floor(2000000 a / (l + r)), in decimals. A candidate goes if a longer
one holds its words and at least 80 % of its occurrences.

Defined cases: a null language is ``und``; null and empty texts have no words; a
very long text is read in blocks that overlap by three words; repeated rows count as
they occur; ties in score and count go by the phrase's bytes; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty, workers

SUPPORT = 30
LONGEST = 4
SHARDS = 4
TOP = 2000
SCALE = 2_000_000
#: A candidate goes if a longer one has this share (in percent) of its occurrences.
HELD = 80
#: Bits of a level's filter at most, and bits for each of its keys.
FILTER_BITS, BITS_EACH = 1 << 28, 16
#: Bytes of text that are parsed at once, and counts that a task holds before it sends them.
BLOCK = 1 << 20
HELD_COUNTS = 1 << 19
#: Rows of a batch that leaves a task.
SLICE = 1 << 15

_KIND = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_MASK60 = np.uint64((1 << 60) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 ... B^(n - 1) and the inverse powers, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        base = int(_ODD[0])
        _POWERS[:] = [np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64))) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of a block: byte edges, pieces, hashes; the first ``own`` of them begin in the block itself."""

    def __init__(self, text: bytes, own_bytes: int, salt: int):
        self.text = text.translate(_KIND)
        raw = np.frombuffer(self.text, dtype=np.uint8)
        stop = raw == 10
        inside = np.zeros(len(raw) + 2, dtype=np.int8)
        inside[1:-1] = ~(stop | (raw == 32))
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.cumsum(stop)[self.start] if len(self.start) else self.start
        self.own = int(np.searchsorted(self.start, own_bytes))
        up, down = powers(len(raw) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])))
        made = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(made + (self.end - self.start).astype(np.uint64) * _ODD[2] + np.uint64(salt))

    def windows(self, n: int, own: int | None = None) -> np.ndarray:
        """First words of all runs of n words in one piece that begin in the block itself (or its first ``own`` words)."""
        last = min(self.own if own is None else own, len(self.start) - n + 1)
        if last <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 : n - 1 + last])

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        """60-bit hashes of the n words from each place."""
        made = self.hash[at]
        for k in range(1, n):
            made = mix(made * _ODD[3] + self.hash[at + k])
        return (made + np.uint64(n)) & _MASK60

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Every word's number, and the distinct words."""
        raw = np.frombuffer(self.text, dtype=np.uint8)
        body = raw[(raw != 10) & (raw != 32)].tobytes()
        edges = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int32)
        made = pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(body)]).dictionary_encode()
        return made.indices.to_numpy().astype(np.int64), made.dictionary.cast(pa.string())


def cut_text(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """(block, own bytes) of a long text: cuts lie between words, a block sees the next three words too."""
    at = 0
    while at < len(raw):
        end = next_gap(raw, at + BLOCK)
        see = end
        for _ in range(LONGEST - 1):
            while see < len(raw) and raw[see] in b" \t":
                see += 1
            see = next_gap(raw, see)
        yield raw[at:see], end - at
        at = end


def next_gap(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] not in b" \t\n\r\x0b\x0c.,;:!?":
        at += 1
    return min(at, len(raw))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, int]]:
    """(lang, shard, text, own bytes) from (lang, shard, text) rows; small texts of a kind are joined."""
    held: dict[tuple[str, int], list[bytes]] = {}
    sizes: dict[tuple[str, int], int] = {}
    total = 0

    def send(key):
        text = b"\n".join(held.pop(key))
        sizes.pop(key)
        return *key, text, len(text)

    for batch in batches:
        for lang, shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.as_py().encode()
            if len(raw) > BLOCK:
                for part, own in cut_text(raw):
                    yield lang, shard, part, own
                continue
            key = (lang, shard)
            held.setdefault(key, []).append(raw)
            sizes[key] = sizes.get(key, 0) + len(raw) + 1
            total += len(raw) + 1
            if sizes[key] >= BLOCK:
                total -= sizes[key]
                yield send(key)
            elif total >= 8 * BLOCK:  # many languages, few texts of each
                for other in list(held):
                    yield send(other)
                total = 0
    for key in list(held):
        yield send(key)


def salt_of(lang: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(lang.encode())


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Words]]:
    for lang, shard, text, own in blocks(batches):
        made = Words(text, own, salt_of(lang))
        if made.own:
            yield lang, shard, made


class Filter:
    """Bloom filter of 60-bit keys, two probes each."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        mask = np.uint64(self.size - 1)
        probe = lambda slot: (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        first = np.flatnonzero(probe(keys & mask))
        out[first[probe((keys[first] >> np.uint64(30)) & mask) == 1]] = True
        return out


def build_filter(keys: DataFrame) -> Filter:
    """Filter of the column ``h``; its bitmaps (at most ``FILTER_BITS`` bits) are made in Spark and joined on the driver."""
    n = keys.count()
    size = 1 << max(15, min(int(math.log2(FILTER_BITS)), math.ceil(math.log2(max(1, n * BITS_EACH)))))
    slot = F.explode(F.array(*(F.shiftright("h", s).bitwiseAND(F.lit(size - 1)) for s in (0, 30))))
    maps = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("map"))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in maps.collect():
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["map"], dtype=np.uint8)[: len(bits) - at]
    return Filter(bits, size)


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices, which the receiving side buffers one at a time."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def shard_keys(h: np.ndarray, shard: int) -> np.ndarray:
    """Keys of a shard's own phrases."""
    return (h + np.uint64(shard * int(_ODD[1]) & int(_MASK60))) & _MASK60


def count_shards(rows: DataFrame, lengths: tuple[int, ...], parts: int, known) -> DataFrame:
    """h, shard, n: counts of the phrases of these lengths whose runs of ``parts`` words are all in the filter."""

    def run(batches: Iterator[pa.RecordBatch]):
        waiting: dict[int, list[np.ndarray]] = {}

        def send(shard):
            h, n = np.unique(np.concatenate(waiting.pop(shard)), return_counts=True)
            return small(pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(len(h), shard, dtype=np.int32)), pa.array(n)], names=["h", "shard", "n"]))

        for _, shard, words in parsed(batches):
            usable = None
            if known is not None:
                runs = words.windows(parts, len(words.start))
                usable = np.zeros(len(words.start) + LONGEST, dtype=bool)
                usable[runs] = known.value.has(shard_keys(words.grams(runs, parts), shard))
            for n in lengths:
                at = words.windows(n)
                if usable is not None:
                    for k in range(n - parts + 1):
                        at = at[usable[at + k]]
                waiting.setdefault(shard, []).append(words.grams(at, n))
            if sum(map(len, waiting[shard])) > HELD_COUNTS:
                yield from send(shard)
        for shard in list(waiting):
            yield from send(shard)

    return workers(rows).mapInArrow(run, "h long, shard int, n long").groupBy("h", "shard").agg(F.sum("n").alias("n"))


def count_words(rows: DataFrame) -> DataFrame:
    """lang, shard, n: word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[tuple[str, int], int] = {}
        for lang, shard, words in parsed(batches):
            seen[lang, shard] = seen.get((lang, shard), 0) + words.own
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "shard", "n"])

    return workers(rows).mapInArrow(run, "lang string, shard int, n long").groupBy("lang", "shard").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, need: list[int]) -> DataFrame:
    """h, shard of the phrases that reach their shard's support."""
    return counts.where(F.col("n") >= F.element_at(F.array(*(F.lit(x).cast("long") for x in need)), F.col("shard") + 1)).select("h", "shard")


def local_key() -> Column:
    """SQL twin of ``shard_keys``: (h + shard * odd) modulo 2^60."""
    odd = int(_ODD[1]) & ((1 << 60) - 1)
    moved = F.element_at(F.array(*(F.lit(s * odd % (1 << 60)) for s in range(SHARDS))), F.col("shard") + 1)
    return (F.col("h") + moved).bitwiseAND(F.lit((1 << 60) - 1))


def count_candidates(rows: DataFrame, known) -> DataFrame:
    """lang, phrase, words, f: exact counts of every phrase in the filter, by its text.

    A task counts block by block; Spark's partial aggregation, which may spill, joins its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for lang, _, words in parsed(batches):
            code, names = words.codes()
            for n in range(1, LONGEST + 1):
                at = words.windows(n)
                at = at[known.value.has(words.grams(at, n))]
                if not len(at):
                    continue
                key = code[at]
                for k in range(1, n):
                    if k == LONGEST - 1:  # keeps the products below 2^63
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * len(names) + code[at + k]
                _, first, count = np.unique(key, return_index=True, return_counts=True)
                spoken = [names.take(pa.array(code[at[first] + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*spoken, " ") if n > 1 else spoken[0]
                yield from small(pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrase, pa.array(np.full(len(first), n, dtype=np.int32)), pa.array(count)], names=["lang", "phrase", "words", "f"]))

    return workers(rows).mapInArrow(run, "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def mine(documents: DataFrame, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to four words with f >= support, and (lang, n): all words."""
    spark = documents.sparkSession
    shard = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SHARDS)).cast("int")
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), shard.alias("shard"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    totals = stage(count_words(rows), "son-words")
    by_shard = {r["shard"]: r["n"] for r in totals.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    everything = max(1, sum(by_shard.values()))
    need = [max(1, -(-support * by_shard.get(s, 0) // everything)) for s in range(SHARDS)]
    found, known = [], None
    for lengths, parts in (((1,), 0), ((2,), 1), ((3, 4), 2)):
        level = stage(frequent(count_shards(rows, lengths, parts, known), need), "son-level")
        found.append(level.select("h"))
        if lengths[-1] < LONGEST:
            known = spark.sparkContext.broadcast(build_filter(level.select(local_key().alias("h"))))
    union = found[0].unionAll(found[1]).unionAll(found[2]).distinct()
    candidates = spark.sparkContext.broadcast(build_filter(union))
    exact = stage(count_candidates(rows, candidates).where(F.col("f") >= support), "son-counts")
    return exact, totals.groupBy("lang").agg(F.sum("n").alias("n"))


def score(exact: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best candidates."""
    longer = exact.where("words > 1")
    parts = "transform(sequence(1, words - 1), k -> struct(k, array_join(slice(w, 1, k), ' ') AS head, array_join(slice(w, k + 1, words - k), ' ') AS rest))"
    cuts = longer.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "words", F.col("f").alias("a"), F.inline(F.expr(parts)))
    side = lambda name, out: exact.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    wide = "decimal(20,0)"
    value = F.expr(f"(CAST({SCALE} AS decimal(8,0)) * CAST(a AS {wide})) div (CAST(l AS {wide}) + CAST(r AS {wide}))")
    worst = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(value.cast("long").alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("m"))
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))"
    held = longer.where("words > 2").withColumn("w", F.split("phrase", " ")).select("lang", F.explode(F.expr(inner)).alias("phrase"), F.col("f"))
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.expr(f"longest IS NULL OR 100 * CAST(longest AS {wide}) < {HELD} * CAST(a AS {wide})"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(documents: DataFrame, support: int = SUPPORT, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return score(*mine(documents, support, id_col, text_col, lang_col), top)
