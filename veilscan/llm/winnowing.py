"""Document fingerprints by winnowing.

Every run of ``K`` code points gets a rolling polynomial hash. In each window of
``W`` neighbouring hashes the smallest is chosen, the rightmost one where
several are equal; what some window chose is a mark, kept with its position.
So any piece of ``W + K - 1`` code points that two texts share gives both of them
a common mark (and its place in each), and pieces shorter than ``K`` give none.
A text with fewer than ``W`` hashes is one window; a text of fewer than ``K``
code points is one run of its own length; the empty text has no marks.

The likeness of two fingerprints is the Jaccard measure of their marks' hashes,
each as often as it occurs (1 for two empty ones), so a text of one repeated
line counts by its length.

``neighbours`` compares every row with the row that follows it in the order of
descending ids, and with an edited text made from both. The rows are sorted
once by range, so the text is shuffled once and each task streams over its
slice; only the last row of a slice needs a row of another task. These edge
rows (two a slice) are written beside the results and joined afterwards.

Defined cases: a null text is empty; rows without an id come last; rows that
share an id are ordered by the hash of their text, then as read; repeated rows
are rows like others and lie next to each other; a lone row follows itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, work_dir, workers

#: Code points of a run, and hashes of a window.
K, W = 8, 6
#: Odd multiplier of the rolling hash, and of its final mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)

RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long"
EDGE = "pid int, edge string, body string"


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k code points from every position: sum of point * BASE^(k - 1 - place).

    Runs are built from runs of powers of two: hash(a + b) = hash(a) * BASE^len(b) + hash(b).
    """
    power, length, at = points.astype(np.uint64) + np.uint64(1), 1, None
    done, factor = 0, np.array([BASE])  # an array wraps around silently
    while True:
        if k & length:
            if at is None:
                at = power
            else:
                n = len(points) - done - length + 1
                at = at[:n] * factor + power[done : done + n]
            done += length
        if done == k:
            break
        n = len(power) - length
        power = power[:n] * factor + power[length : length + n]
        factor = factor * factor
        length *= 2
    at = (at ^ (at >> np.uint64(31))) * SPREAD
    return at ^ (at >> np.uint64(29))


def rightmost_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Of every window of ``w`` hashes the place of the smallest, the rightmost of equal ones; each place once."""
    w = min(w, len(hashes))
    best, width = np.arange(len(hashes)), 1
    while width < w:
        step = min(width, w - width)  # the last two windows may overlap
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return best[np.append(True, best[1:] != best[:-1])] if len(best) else best


def marks(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the text's marks, in the order of the text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if not len(points):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    hashes = rolling(points, min(k, len(points)))
    at = rightmost_minima(hashes, w)
    return hashes[at], at


def digest(made: tuple[np.ndarray, np.ndarray]) -> str:
    """Hex digest of a fingerprint: its hashes and positions."""
    return hashlib.sha256(made[0].astype("<u8").tobytes() + made[1].astype("<i8").tobytes()).hexdigest()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard measure of two bags of hashes, given as distinct hashes and their counts."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, at, there = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][there]).sum())
    return both / (total - both)


def bag(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first code points of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


class Row:
    """A text with its fingerprint, computed once."""

    def __init__(self, text: str, k: int, w: int):
        self.text = text
        self.marks = marks(text, k, w)
        self.bag = bag(self.marks[0])
        self.digest = digest(self.marks)

    def against(self, following: Row, k: int, w: int) -> tuple:
        """The row's values of ``RESULT``."""
        other = edited(self.text, following.text)
        made = marks(other, k, w)
        return (
            len(self.text), hashlib.sha256(other.encode()).hexdigest(), self.digest, digest(made),
            likeness(self.bag, bag(made[0])), likeness(self.bag, following.bag), len(self.marks[0]),
        )


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """id and ``marks`` (hash, position) of every row; the map side of any match by shared marks."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [marks(t.as_py(), k, w) for t in batch.column(1)]
            edges = np.cumsum([0, *[len(m[0]) for m in made]])
            flat = [np.concatenate([np.empty(0, dtype=kind), *[m[c].astype(kind) for m in made]]) for c, kind in ((0, np.uint64), (1, np.int64))]
            inner = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1])], names=["hash", "position"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), inner)], names=["doc_id", "marks"])

    kind = documents.schema[id_col].dataType.simpleString()
    return workers(rows).mapInArrow(run, f"doc_id {kind}, marks array<struct<hash: long, position: long>>")


def neighbours(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint, its edited text's, and the likeness to that and to the next row in descending id order."""
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col).cast("string")).alias("text"))
    # the running number spreads repeated rows over slices
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("spread")]
    laid = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        before: tuple | None = None  # id and Row of the row that waits for its next
        for batch in batches:
            ids, out = [], []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = Row(text.as_py(), k, w)
                if before is None:
                    yield record([None], [None], pid, "first", row.text)
                else:
                    ids.append(before[0])
                    out.append(before[1].against(row, k, w))
                before = (one, row)
            yield record(ids, out)
        if before is not None:
            yield record([before[0]], [None], pid, "last", before[1].text)

    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def record(ids: list, out: list, pid: int | None = None, edge: str | None = None, body: str | None = None) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = [pa.array(ids, to_arrow_type(id_type))]
        columns += [pa.array([row and row[c] for row in out], t) for c, t in enumerate(types)]
        columns += [pa.array([x] * len(ids), t) for x, t in ((pid, pa.int32()), (edge, pa.string()), (body, pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "pid", "edge", "body"])

    id_type = documents.schema[id_col].dataType
    path = work_dir(spark, "winnow")
    workers(laid).mapInArrow(run, f"doc_id {kind}, {RESULT}, {EDGE}").write.parquet(path)
    made = spark.read.parquet(path)
    edges = made.where("edge IS NOT NULL")
    # one number for each slice that has rows
    slices = sorted(r[0] for r in edges.where("edge = 'first'").select("pid").collect())
    turn = spark.createDataFrame([(p, slices[(n + 1) % len(slices)]) for n, p in enumerate(slices)], "pid int, next_pid int")
    last = edges.where("edge = 'last'").select("doc_id", "pid", "body").join(turn, "pid")
    first = edges.where("edge = 'first'").select(F.col("pid").alias("next_pid"), F.col("body").alias("next_body"))

    def close(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [Row(a.as_py(), k, w).against(Row(b.as_py(), k, w), k, w) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([row[c] for row in out], t) for c, t in enumerate(types)]], names=["doc_id", *names])

    closed = workers(last).join(first, "next_pid").select("doc_id", "body", "next_body").mapInArrow(close, f"doc_id {kind}, {RESULT}")
    return made.where("edge IS NULL").select("doc_id", *names).unionAll(closed)
