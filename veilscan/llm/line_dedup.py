"""Line dedup by content-defined chunks of lines.

A line ends at a newline or after a punctuation mark followed by a space, so a
passage pasted into running text has lines too. A rolling hash over each pair
of neighbouring line hashes is a local minimum at about every third gap; those
gaps are the chunk boundaries. They depend only on the lines around them, so an
insertion moves no boundary beyond its neighbours. Document ends never cut off
a lone line.

A chunk of two or more lines and at least ``MIN_WORDS`` words is removed
wherever it occurs after its first occurrence (smallest document id, then
position). Equal 64-bit hashes only propose: for each hash the smallest and
the largest chunk text are compared byte by byte in the aggregate, which proves
all of them equal, and a hash shared by different texts removes nothing.

A document of which less than ``MIN_KEPT`` of its bytes stays, and no chunk of
``MIN_WORDS`` words or more, is marked ``copied``: what is left are the edits
of a copy. First occurrences and passages found nowhere else are such chunks,
so dropping the copied documents loses none of them.

Shuffles: eligible chunk texts once (combined on the map side, so a hot chunk
sends one row a task), their hashes once, and the documents once to meet their
lists of removed chunks.

Defined cases: null and empty texts pass unchanged; documents of one line are
never changed; rows that share an id are one document to the operator, so
repeated rows lose the same chunks; rows without an id are told apart by their
text and come first; very long texts are cut like others, in one pass; extra
columns are carried, except those named like the operator's own (``OWN``, with
the caller's prefix), which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers

LINE_END = re.compile(rb"[.!?,;:][ \t]+|\n")
#: Columns that the operator adds.
OWN = ("removed_chunks", "removed_bytes", "copied")
MIN_LINES = 2
MIN_WORDS = 8
MIN_KEPT = 0.3
ODD_A = np.uint64(0x9E3779B97F4A7C15)
ODD_B = np.uint64(0xD6E8FEB86659FD93)


def line_edges(text: bytes) -> list[int]:
    """Start of every line, and the end of the text."""
    edges = [0, *[m.end() for m in LINE_END.finditer(text)]]
    if edges[-1] < len(text):
        edges.append(len(text))
    return edges


def boundaries(hashes: np.ndarray) -> np.ndarray:
    """Gaps (before line g + 1) that hold a chunk boundary: local minima of the rolling pair hash."""
    if len(hashes) < 4:
        return np.empty(0, dtype=np.int64)
    roll = hashes[:-1] * ODD_A + hashes[1:]
    roll = (roll ^ (roll >> np.uint64(31))) * ODD_B
    roll ^= roll >> np.uint64(29)
    inner = roll[1:-1]
    return np.flatnonzero((inner < roll[:-2]) & (inner <= roll[2:])) + 1


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, lines) of the text's chunks in order; they cover it."""
    from xxhash import xxh3_64_intdigest

    edges = line_edges(text)
    count = len(edges) - 1
    if count < 1:
        return []
    cuts: list[int] = []
    if count >= 4:
        hashes = np.array([xxh3_64_intdigest(text[a:b].rstrip()) for a, b in zip(edges, edges[1:], strict=False)], dtype=np.uint64)
        cuts = (boundaries(hashes) + 1).tolist()
    ends = [*cuts, count]
    return [(edges[a], edges[b], b - a) for a, b in zip([0, *cuts], ends, strict=True)]


def has_words(body: bytes) -> bool:
    return len(body.split(None, MIN_WORDS)) >= MIN_WORDS


def eligible(body: bytes, lines: int) -> bool:
    return lines >= MIN_LINES and has_words(body)


def digest(body: bytes) -> int:
    """Signed 64-bit hash of a chunk."""
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(body, 1)
    return x - (1 << 64) if x >> 63 else x


def chunk_rows(keyed: DataFrame, with_body: bool) -> DataFrame:
    """One row for each eligible chunk of (id, alt, text) rows."""
    id_type = keyed.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, alt long, pos int, h long" + (", body string" if with_body else "")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, pos, hashes, bodies = [], [], [], []
            for k, text in enumerate(batch.column(2)):
                raw = (text.as_py() or "").encode()
                for n, (start, end, lines) in enumerate(chunks(raw)):
                    body = raw[start:end].rstrip()
                    if eligible(body, lines):
                        row.append(k)
                        pos.append(n)
                        hashes.append(digest(body))
                        if with_body:
                            bodies.append(body)
            at = pa.array(row, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(pos, pa.int32()), pa.array(hashes, pa.int64())]
            names = ["id", "alt", "pos", "h"]
            if with_body:
                columns.append(pa.array(bodies, pa.binary()).cast(pa.string()))
                names.append("body")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return workers(keyed).mapInArrow(run, schema)


def alternate(id_col: Column, text: Column) -> Column:
    """What tells rows without an id apart; null for all others."""
    return F.when(id_col.isNull(), F.xxhash64(text))


def removals(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, alt, gone: number and hash of the chunks that each document loses."""
    keyed = documents.select(F.col(id_col).alias("id"), alternate(F.col(id_col), F.col(text_col)).alias("alt"), F.col(text_col).cast("string").alias("text"))
    repeated = (
        chunk_rows(keyed, True)
        .groupBy("h")
        .agg(F.min("body").alias("low"), F.max("body").alias("high"), F.min(F.struct("id", "alt", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND low = high")
        .select("h", "first")
    )
    found = chunk_rows(keyed, False).join(repeated, "h")
    later = found.where(~F.struct("id", "alt", "pos").eqNullSafe(F.col("first")))
    # bounded by the document's own chunks; equal rows name each chunk once
    return later.groupBy("id", "alt").agg(F.collect_set(F.struct("pos", "h")).alias("gone"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept: float = MIN_KEPT, prefix: str = "") -> DataFrame:
    """The rows with the shortened text, ``removed_chunks``, ``removed_bytes`` and ``copied`` (after ``prefix``)."""
    names = [prefix + c for c in OWN]
    documents = documents.drop(*(c for c in names if c not in (id_col, text_col)))
    gone = removals(documents, id_col, text_col).select(F.col("id").alias("__id"), F.col("alt").alias("__alt"), F.col("gone").alias("__gone"))
    same = documents[id_col].eqNullSafe(gone["__id"]) & alternate(documents[id_col], documents[text_col]).eqNullSafe(gone["__alt"])
    own = [documents[c] for c in documents.columns]
    rows = documents.join(gone, same, "left").select(*own, "__gone")
    kinds = T.StructType([*documents.schema.fields, *(T.StructField(c, t) for c, t in zip(names, (T.IntegerType(), T.LongType(), T.BooleanType()), strict=True))])
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, counts, sizes, copied = [], [], [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                lost = {(x["pos"], x["h"]) for x in gone.as_py() or ()}
                raw = text.as_py().encode() if lost else b""
                parts = [(raw[a:b], n) for n, (a, b, _) in enumerate(chunks(raw))]
                # rows that share an id share the list: a chunk goes where its own hash is meant
                held = [part for part, n in parts if (n, digest(part.rstrip())) not in lost]
                if len(held) == len(parts):
                    texts.append(text.as_py())
                    counts.append(0)
                    sizes.append(0)
                    copied.append(False)
                    continue
                kept = b"".join(held)
                texts.append(kept.decode())
                counts.append(len(parts) - len(held))
                sizes.append(len(raw) - len(kept))
                copied.append(len(kept.strip()) < min_kept * len(raw) and not any(has_words(part) for part in held))
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            columns += [pa.array(counts, pa.int32()), pa.array(sizes, pa.int64()), pa.array(copied, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=kinds.fieldNames())

    return workers(rows).mapInArrow(run, kinds)
