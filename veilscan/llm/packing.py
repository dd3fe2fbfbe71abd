"""Cost-balanced packing of documents into training sequences.

A document's ids and its end id are cut into full sequences of ``length`` ids
and a rest. The cost of a piece of n ids is ``linear * n + quadratic * n^2``
(attention stays inside a document). Rests are taken in descending cost and go
to the lowest-cost sequence that has token capacity left; what does not fit
there is cut off and goes on as a piece of its own to the next one.

A block of rests gets exactly as many ids of capacity as it has: whole
sequences plus, for the remainder, sequences of power-of-two lengths, which
need no padding. So every sequence is full and nothing is padded.

Everything happens inside the task that reads a document; only metadata leaves
it, so the job has no shuffle and a hot source, long texts or many copies make
no task larger than its input split. Memory: one Arrow batch and one block of
rests. Sequence ids carry the partition number in their upper bits, so they
are unique and the same when a lost task runs again.

Defined cases: a null or empty text is one piece holding the end id; a repeated
row is packed as often as it occurs; null ids are carried; an empty table
gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

LENGTH = 1024
#: Rests that are balanced together: bounds a task's memory (4096 * 1023 ids at most).
BLOCK = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
#: Texts above this many characters go through the slower reference encoder.
LONG_TEXT = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of the vocabulary file at ``path``; the tokenizers library and tiktoken give the same ids.

    A byte-level BPE merges the pair whose result has the smallest id, so the
    vocabulary itself holds the ranks and tiktoken, which is several times
    faster, can read them. Very long texts take the tokenizers library.

    With ``markers`` a special token written out in a text gets its own id, as
    in the library's plain ``encode(text, add_special_tokens=False)``; without,
    it is ordinary text (``encode_special_tokens``).
    """

    def __init__(self, path: str, markers: bool = False):
        import public_tokenizers
        import tiktoken

        self.path = path
        self.markers = markers
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in word): k for word, k in made["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if markers else {})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32, copy=False)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.markers
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, markers: bool = False) -> Encoder:
    if (path, markers) not in _ENCODERS:
        _ENCODERS[path, markers] = Encoder(path, markers)
    return _ENCODERS[path, markers]


def capacities(total: int, length: int) -> list[int]:
    """Whole sequences, then the powers of two that make up the remainder."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balance(sizes: list[int], length: int, linear: float = 1.0, quadratic: float = 1.0) -> list[list[tuple[int, int, int, int]]]:
    """Pack pieces of the given sizes: for each sequence its (piece, from, count, offset)."""

    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    room = capacities(sum(sizes), length)
    placed: list[list[tuple[int, int, int, int]]] = [[] for _ in room]
    used = [0] * len(room)
    lowest = [(0.0, k) for k in range(len(room))]
    todo = [(-cost(n), k, 0, n) for k, n in enumerate(sizes)]
    heapq.heapify(todo)
    while todo:
        _, piece, start, n = heapq.heappop(todo)
        spent, k = heapq.heappop(lowest)
        part = min(n, room[k] - used[k])
        placed[k].append((piece, start, part, used[k]))
        used[k] += part
        if used[k] < room[k]:
            heapq.heappush(lowest, (spent + cost(part), k))
        if part < n:
            heapq.heappush(todo, (-cost(n - part), piece, start + part, n - part))
    return placed


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, block: int, linear: float, quadratic: float, first_id: int, markers: bool = False) -> Iterator[pa.RecordBatch]:
    """Pieces of the (doc_id, text) batches of one partition."""
    encode = encoder(path, markers)
    next_id = first_id
    out: list[tuple] = []
    rests: list[tuple] = []  # doc_id, start, ids, doc tokens

    def close() -> None:
        nonlocal next_id
        for parts in balance([len(r[2]) for r in rests], length, linear, quadratic):
            whole = sum(p[2] for p in parts)
            for piece, start, count, offset in parts:
                doc, base, ids, tokens = rests[piece]
                out.append((doc, base + start, count, _crc(ids[start : start + count]), tokens, next_id, offset, whole))
            next_id += 1
        rests.clear()

    def flush() -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
            full = len(ids) // length * length
            for start in range(0, full, length):
                out.append((doc, start, length, _crc(ids[start : start + length]), len(ids), next_id, 0, length))
                next_id += 1
            if full < len(ids):
                rests.append((doc, full, ids[full:].copy(), len(ids)))
                if len(rests) >= block:
                    close()
            if len(out) >= 20_000:
                yield flush()
    close()
    if out:
        yield flush()


def pack(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = 0, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1.0, markers: bool = False) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        yield from pack_batches(batches, vocabulary, end_id, length, block, linear, quadratic, first, markers)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return workers(rows).mapInArrow(run, SCHEMA)
