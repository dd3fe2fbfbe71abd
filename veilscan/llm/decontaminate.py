"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared as bytes with A-Z lower-cased and runs of white
space (and zero bytes) made one space. An item of m bytes may occur with up to
e = floor(rate * m) edits. Each edit destroys at most q of its m - q + 1 q-grams,
so a region holding such an occurrence shares at least m + 1 - q (e + 1) of
them, and they lie on diagonals (text position minus item position) no more
than 2 e apart. Shared q-grams are counted in diagonal bands that overlap by
half; bands that reach the bound are aligned inside their band and kept if the
edit distance is within the budget.

Documents are only scanned, never shuffled. The item index is broadcast; its
size is bounded by ``INDEX_BYTES`` of item text, and a larger benchmark is cut
into blocks of that size, each scanned against all documents. Shared q-grams are
expanded ``PAIRS`` at a time and kept as counts of bands, so text and items of one
repeated letter need no more memory than others.

Defined cases: null or empty texts have no hits; very long texts are scanned in
windows of ``SCAN_BYTES`` that overlap by the longest occurrence; null and empty items match
nothing; items shorter than q bytes match only exactly; repeated documents
and repeated items give a hit each; extra columns are ignored by ``find_leaks``.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

#: q-gram length in bytes, 9 to 16.
Q = 12
#: Edits for each byte of an item.
RATE = 0.06
#: Item text in one broadcast index (its arrays are about 25 times that).
INDEX_BYTES = 4 << 20
#: Bytes of text that are scanned at once in a task.
SCAN_BYTES = 1 << 20
#: Shared q-grams (text place, item place) that are counted at once.
PAIRS = 1 << 20
TABLE_BITS = 22
#: Odd multipliers of the code and of its slot.
SPREAD = np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "item_id long, start long, end long, edits int"


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().replace(b"\0", b" ").lower().split())


def grams(buf: bytes) -> np.ndarray:
    """A 64-bit code of the q-gram at every position: its first and its last eight bytes, mixed."""
    n = len(buf) - 7
    if n <= Q - 8:
        return np.empty(0, dtype=np.uint64)
    words = np.empty(n, dtype="<u8")
    for k in range(min(8, n)):
        words[k::8] = np.frombuffer(buf, dtype="<u8", count=(n - k + 7) // 8, offset=k)
    out = words[: n - (Q - 8)] * SPREAD
    out += words[Q - 8 :]
    return out


def budget(size: int, rate: float) -> int:
    """Edits allowed in an item: the rate's, as far as the lemma still asks for a shared q-gram.

    That holds back one edit of items of 17 to 23, 34, 35 and 84 bytes or so, at the usual rate.
    """
    return max(0, min(int(rate * size), size // Q - 1))


class Index(NamedTuple):
    ids: list
    items: list[bytes]
    edits: np.ndarray  # budget of each item
    need: np.ndarray  # shared q-grams asked for
    band: int  # band step; bands are two steps wide
    codes: np.ndarray  # distinct codes, sorted
    first: np.ndarray  # postings of each code: first[k] to first[k + 1]
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # one byte for each hash slot: may the code occur?
    reach: int  # bytes that one occurrence's q-grams span at most


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes * MIX) >> np.uint64(64 - TABLE_BITS)


def build_index(rows: list[tuple[int, str | None]], rate: float = RATE) -> Index:
    kept = [(k, b) for k, t in rows if (b := normal(t))]
    items = [b for _, b in kept]
    edits = np.array([budget(len(b), rate) for b in items], dtype=np.int64)
    need = np.array([max(1, len(b) + 1 - Q * (e + 1)) for b, e in zip(items, edits.tolist(), strict=True)], dtype=np.int64)
    made = [grams(b) for b in items]
    codes = np.concatenate([np.empty(0, dtype=np.uint64), *made])
    item = np.repeat(np.arange(len(items)), [len(m) for m in made])
    place = np.concatenate([np.empty(0, dtype=np.int64), *[np.arange(len(m)) for m in made]])
    order = np.argsort(codes, kind="stable")
    unique, first = np.unique(codes[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[slots(unique)] = True
    return Index([k for k, _ in kept], items, edits, need, int(2 * edits.max(initial=0) + 1), unique, np.append(first, len(codes)), item[order], place[order], table, max(map(len, items), default=0) + int(edits.max(initial=0)))


def align(item: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best (edits, start, end) of ``item`` in ``text`` on diagonals ``low`` to ``high``, if within ``most``.

    Row j of the band holds text ends low + j ... high + j; the start is free.
    """
    width = high - low + 1
    letters = np.frombuffer(text, dtype=np.uint8)
    far = np.int64(1 << 30)
    ends = np.arange(low, high + 1)
    ramp = np.arange(width)
    row = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    begin = ends.copy()
    for j, c in enumerate(item):
        at = ends + j  # text position read by the diagonal step
        inside = (at >= 0) & (at < len(text))
        unlike = np.ones(width, dtype=np.int64)
        unlike[inside] = letters[at[inside]] != c
        step = np.where(inside, row + unlike, far)
        down_from = np.append(row[1:], far) + 1  # the item's byte is missing in the text
        best = np.where(down_from < step, down_from, step)
        start = np.where(down_from < step, np.append(begin[1:], 0), begin)
        # an extra text byte: from the left neighbour in the same row
        offset = best - ramp
        run = np.minimum.accumulate(offset)
        source = np.maximum.accumulate(np.where(offset == run, ramp, 0))
        row = np.minimum(run + ramp, far)
        begin = start[source]
        row[(at + 1 < 0) | (at + 1 > len(text))] = far
    k = int(row.argmin())
    if row[k] > most:
        return None
    return int(row[k]), int(begin[k]), int(ends[k] + len(item))


def crowded(hit: np.ndarray, need: int, reach: int) -> np.ndarray:
    """The positions that lie with ``need`` or more of their kind inside ``reach`` bytes."""
    if len(hit) < need:
        return hit[:0]
    lead = np.flatnonzero(hit[need - 1 :] - hit[: len(hit) - need + 1] <= reach)
    edge = np.zeros(len(hit) + 1, dtype=np.int32)
    np.add.at(edge, lead, 1)
    np.add.at(edge, lead + need, -1)
    return hit[np.cumsum(edge[:-1]) > 0]


def count_cells(index: Index, hit: np.ndarray, k: np.ndarray, size: int, step: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal cells (item * span + diagonal // step) and the shared q-grams in each."""
    many = index.first[k + 1] - index.first[k]
    cells, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(many)))
    at = 0
    while at < int(total[-1]):  # pairs at to end, by their number in the expanded order
        end = min(at + PAIRS, int(total[-1]))
        low, high = (int(x) for x in (np.searchsorted(total, at, side="right") - 1, np.searchsorted(total, end, side="left")))
        own = np.arange(low, high)
        begin, stop = np.maximum(total[own], at), np.minimum(total[own + 1], end)
        each = np.repeat(own, stop - begin)
        post = np.arange(at, end) - total[each] + index.first[k[each]]
        cell = index.item[post] * span + (hit[each] - index.place[post] + size) // step
        new, seen = np.unique(cell, return_counts=True)
        merged, where = np.unique(np.concatenate((cells, new)), return_inverse=True)
        sums = np.zeros(len(merged), dtype=np.int64)
        np.add.at(sums, where, np.concatenate((counts, seen)))
        cells, counts = merged, sums
        at = end
    return cells, counts


def scan(index: Index, buf: bytes, starts: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """(text number, item): regions (edits, start, end) of the texts joined in ``buf`` at ``starts``.

    Texts are set apart by q zero bytes, which no q-gram of an item spans.
    """
    codes = grams(buf)
    hit = np.flatnonzero(index.table[slots(codes)])
    hit = crowded(hit, int(index.need.min(initial=1)), index.reach)
    got = codes[hit]
    k = np.searchsorted(index.codes, got)
    k[k == len(index.codes)] = 0
    same = index.codes[k] == got if len(index.codes) else np.zeros(len(got), dtype=bool)
    hit, k = hit[same], k[same]
    step = index.band
    span = 2 * len(buf) // step + 3
    cells, counts = count_cells(index, hit, k, len(buf), step, span)
    # band c covers cells c - 1 and c: any 2 e + 1 neighbouring diagonals lie in one band
    lone = np.zeros(len(cells), dtype=np.int64)
    if len(cells) > 1:
        next_to = cells[1:] == cells[:-1] + 1
        lone[1:][next_to] = counts[:-1][next_to]
    bands = np.concatenate((cells, cells + 1))
    sums = np.concatenate((counts + lone, counts))
    order = np.lexsort((-sums, bands))
    bands, sums = bands[order], sums[order]
    keep = np.concatenate(([True], bands[1:] != bands[:-1])) if len(bands) else np.zeros(0, dtype=bool)
    bands, sums = bands[keep], sums[keep]
    wanted = sums >= index.need[bands // span] if len(bands) else keep
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for band in bands[wanted].tolist():
        i, cell_no = divmod(band, span)
        low = (cell_no - 1) * step - len(buf)
        high = low + 2 * step - 1
        size, most = len(index.items[i]), int(index.edits[i])
        number = first = int(np.searchsorted(starts, max(low, 0), side="right")) - 1
        last = int(np.searchsorted(starts, min(high + size, len(buf) - 1), side="right")) - 1
        for number in range(max(first, 0), last + 1):
            begin = int(starts[number])
            end = int(starts[number + 1]) - Q if number + 1 < len(starts) else len(buf)
            text = buf[begin:end]
            lo, hi = max(low - begin, -most), min(high - begin, len(text) - size + most)
            if lo > hi:
                continue
            exact = text.find(index.items[i], max(lo, 0), max(hi, 0) + size)
            made = (0, exact, exact + size) if exact >= 0 else align(index.items[i], text, lo - most, hi + most, most)
            if made:
                found.setdefault((number, i), []).append(made)
    return found


def apart(regions: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The best regions that do not overlap, as (start, end, edits)."""
    taken: list[tuple[int, int]] = []
    out = []
    for edits, begin, end in sorted(set(regions)):
        at = bisect.bisect(taken, (begin, end))
        if (not at or taken[at - 1][1] <= begin) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (begin, end))
            out.append((begin, end, edits))
    return out


def scan_short(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    for i, item in enumerate(index.items):
        if len(item) < Q:
            for number, text in enumerate(texts):
                at = text.find(item)
                while at >= 0:
                    yield number, i, at, at + len(item), 0
                    at = text.find(item, at + len(item))


def scan_batches(batches: Iterator[pa.RecordBatch], index: Index, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    gap = b"\0" * Q

    def send(hits):
        hits.sort(key=lambda h: h[1:])
        columns = [pa.array([h[0] for h in hits], id_type), pa.array([index.ids[h[2]] for h in hits], pa.int64())]
        columns += [pa.array([h[c] for h in hits], kind) for c, kind in ((3, pa.int64()), (4, pa.int64()), (5, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "end", "edits"])

    def close(ids, texts):
        starts = np.cumsum([0, *[len(t) + Q for t in texts[:-1]]])
        hits = [(ids[n], n, i, *r) for (n, i), regions in scan(index, gap.join(texts), starts).items() for r in apart(regions)]
        return send(hits + [(ids[h[0]], *h) for h in scan_short(index, texts)])

    def long(doc, text):
        found: dict[int, list[tuple[int, int, int]]] = {}
        for at in range(0, len(text), SCAN_BYTES):
            for (_, i), regions in scan(index, text[at : at + SCAN_BYTES + index.reach], np.zeros(1, dtype=np.int64)).items():
                found.setdefault(i, []).extend((e, a + at, b + at) for e, a, b in regions)
        hits = [(doc, 0, i, *r) for i, regions in found.items() for r in apart(regions)]
        return send(hits + [(doc, *h) for h in scan_short(index, [text])])

    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not (made := normal(text.as_py())):
                continue
            if len(made) > SCAN_BYTES:
                yield long(doc, made)
                continue
            ids.append(doc)
            texts.append(made)
            size += len(made)
            if size >= SCAN_BYTES:
                yield close(ids, texts)
                ids, texts, size = [], [], 0
        if texts:
            yield close(ids, texts)


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the normal form), edits of every occurrence within budget."""
    spark = documents.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / index_bytes))
    id_type = documents.schema[id_col].dataType
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = build_index([(r[0], r[1]) for r in block.collect()], rate)
        if not index.items:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_type

            yield from scan_batches(batches, shared.value, to_arrow_type(id_type))

        parts.append(workers(rows).mapInArrow(run, f"doc_id {id_type.simpleString()}, {SCHEMA}"))
    if not parts:
        return spark.createDataFrame([], f"doc_id {id_type.simpleString()}, {SCHEMA}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
