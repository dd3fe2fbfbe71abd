"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays.

Tokens are the lower-cased (A-Z) words between white space and one end token;
the first token's context is a begin mark. Three counting jobs:

1. vocabulary: each task sends its distinct word hashes with counts, by hash
   range; each range becomes a sorted array of hashes and an array of counts.
   A word's id is its place in the concatenated ranges.
2. bigrams: each task sends its distinct (context id, word id) keys with counts.
   Keys go to the shard of their context's range, except that a context with a
   large share of all tokens is spread over all shards by its words, so no
   shard depends on one frequent word. A shard becomes sorted keys and counts,
   and the numbers of its contexts' words seen once, twice and more often.
3. continuations: in how many contexts each word was seen, by id range.

Arrays are files in the shared folder. Workers map them into memory and look up
the sorted distinct keys of a batch, so a worker holds a batch and the pages it
touches, never the model. The driver sees only totals and the spread contexts.

p(w|v) = max(c - D(c), 0) / c(v) + g(v) * p1(w), where
p1(w) = max(k(w) - D'(k), 0) / K + g' / (V + 1), k counts the contexts of w.

Defined cases: a null or empty text is the end token alone; without training
rows every token has probability 1 / (V + 1) = 1; repeated rows count and score
as they occur; a null id belongs to the fold of the empty text; extra columns
are ignored.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, work_dir, workers

#: Text bytes for each shard of the model: bounds what one task merges.
SHARD_BYTES = 64 << 20
#: Text bytes that a task turns into tokens at once.
CHUNK_BYTES = 2 << 20
#: Tokens that a task gathers before it sends its distinct keys.
GATHER = 4 << 20
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
END = np.uint64(0x1F83D9ABFB41BD6B)
BASE = 0x5851F42D4C957F2D
LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 20))
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, and the number of tokens of each text.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running
    sums over the joined texts, and mixed.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = SEPARATORS[buf]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(buf) + 1)
    run = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(LETTERS[buf] * up[:-1], dtype=np.uint64)))
    words = (run[ends] - run[starts]) * down[starts]
    words = (words ^ (words >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    words ^= words >> np.uint64(29)
    close = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(starts, close)  # words up to the end of each text
    return np.insert(words, before, END), np.diff(before, prepend=0) + 1


class Store:
    """Arrays as files of a folder that all machines reach."""

    def __init__(self, uri: str):
        self.uri = uri
        place = urlparse(uri)
        self.path = unquote(place.path) if place.scheme in ("", "file") else None

    def save(self, name: str, array: np.ndarray) -> None:
        """Written aside and renamed, so a task that runs again or twice leaves a whole file."""
        array = np.ascontiguousarray(array)
        if self.path is not None:
            os.makedirs(self.path, exist_ok=True)
            aside = f"{self.path}/{name}.{uuid.uuid4().hex}"
            array.tofile(aside)
            os.replace(aside, f"{self.path}/{name}")
            return
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.uri)
        files.create_dir(root, recursive=True)
        aside = f"{root}/{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(aside) as out:
            out.write(array.tobytes())
        files.move(aside, f"{root}/{name}")

    def load(self, name: str, kind: str) -> np.ndarray:
        """The array mapped into memory; from a remote store by way of an unnamed local file."""
        if self.path is not None:
            path = f"{self.path}/{name}"
            return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.empty(0, dtype=kind)
        import shutil
        import tempfile

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.uri)
        with tempfile.TemporaryFile() as local, files.open_input_stream(f"{root}/{name}") as source:
            shutil.copyfileobj(source, local)
            return np.memmap(local, dtype=kind, mode="r") if local.tell() else np.empty(0, dtype=kind)


def merge(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    all_keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
    if counts is None:
        unique, n = np.unique(all_keys, return_counts=True)
        return unique, n.astype(np.uint64)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1]))) if len(all_keys) else np.empty(0, dtype=np.int64)
    n = np.concatenate(counts)[order].astype(np.uint64)
    return all_keys[first], np.add.reduceat(n, first) if len(first) else n


BLOCK = "shard int, a binary, b binary, c binary"


def block(shard: list[int], *parts: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(shard, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]]
    columns += [pa.array([b""] * len(shard), pa.binary())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays(columns, names=["shard", "a", "b", "c"])


def narrow(counts: np.ndarray) -> bytes:
    """Counts as 32 bits; a chunk never holds more."""
    return counts.astype("<u4").tobytes()


def by_range(shards: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted 64-bit hashes dealt to equal hash ranges."""
    place = range_of(keys, shards)
    cut = np.searchsorted(place, np.arange(shards + 1))
    used = np.flatnonzero(np.diff(cut)).tolist()
    return block(used, [keys[cut[k] : cut[k + 1]].tobytes() for k in used], [narrow(counts[cut[k] : cut[k + 1]]) for k in used])


def range_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def chunked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their lower-cased texts, about CHUNK_BYTES each."""
    for batch in batches:
        texts, size, first = [], 0, 0
        for k, text in enumerate(batch.column(column)):
            raw = (text.as_py() or "").encode().lower()
            texts.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield batch.slice(first, k + 1 - first), texts
                texts, size, first = [], 0, k + 1
        if texts:
            yield batch.slice(first), texts


class Vocabulary:
    """Lookups in the mapped vocabulary; id 0 is the begin mark, -1 an unknown word."""

    def __init__(self, model: Model):
        store = Store(model.uri)
        self.hashes = [store.load(f"words-{k}", "<u8") for k in range(model.shards)]
        self.offsets = np.concatenate(([0], np.cumsum(model.sizes)))
        self.counts = [store.load(f"counts-{k}", "<u8") for k in range(model.shards)]
        self.begin = model.documents

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        place = range_of(hashes, len(self.hashes))
        cut = np.searchsorted(place, np.arange(len(self.hashes) + 1))
        out = np.full(len(hashes), -1, dtype=np.int64)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            words, own = self.hashes[k], hashes[cut[k] : cut[k + 1]]
            if len(words):
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                out[cut[k] : cut[k + 1]] = np.where(words[at] == own, at + self.offsets[k] + 1, -1)
        return out

    def take(self, arrays: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        """Values of id-ordered arrays for sorted ids of at least 1."""
        cut = np.searchsorted(ids, self.offsets + 1)
        parts = [arrays[k][ids[cut[k] : cut[k + 1]] - 1 - self.offsets[k]] for k in np.flatnonzero(np.diff(cut)).tolist()]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training count of sorted ids: 0 for unknown words, the number of documents for the begin mark."""
        known = ids > 0
        out = np.zeros(len(ids), dtype=np.int64)
        out[known] = self.take(self.counts, ids[known])
        out[ids == 0] = self.begin
        return out


class Model(NamedTuple):
    uri: str
    shards: int
    sizes: list[int]  # words of each range
    total: int  # training tokens
    documents: int
    discounts: tuple[float, float, float] = (0, 0, 0)
    low_discounts: tuple[float, float, float] = (0, 0, 0)
    low_kinds: tuple[int, int, int] = (0, 0, 0)  # words seen in one, two, more contexts
    bigrams: int = 0
    wide: dict[int, tuple[int, int, int]] = {}  # the spread contexts' word kinds

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)

    def wide_from(self) -> float:
        """Count from which a context is spread over all shards."""
        return self.total / (8 * self.shards)


def shard_of(context: np.ndarray, word: np.ndarray, spread: np.ndarray, model: Model) -> np.ndarray:
    own = context * model.shards // (model.vocabulary + 1)
    other = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % model.shards
    return np.where(spread, other, own)


def discounts(kinds: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = kinds
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.0
    raw = [k - (k + 1) * y * b / a if a and b and y else 0.75 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _vocabulary_job(rows: DataFrame, model: Model) -> Model:
    shards, uri = model.shards, model.uri

    def count(batches):
        held, size = [], 0
        for _, texts in chunked(batches, 0):
            made, _ = tokens(texts)
            held.append(made)
            size += len(made)
            if size >= GATHER:
                yield by_range(shards, *merge(held))
                held, size = [], 0
        if held:
            yield by_range(shards, *merge(held))

    def reduce(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        words, n = merge([np.frombuffer(x.as_py(), "<u8") for x in table.column("a")], [np.frombuffer(x.as_py(), "<u4") for x in table.column("b")])
        store = Store(uri)
        store.save(f"words-{k}", words)
        store.save(f"counts-{k}", n)
        ends = int(n[words == END].sum())
        return pa.table({"shard": pa.array([k], pa.int32()), "words": [len(words)], "tokens": [int(n.sum())], "documents": [ends]})

    made = workers(rows).mapInArrow(count, BLOCK).groupBy("shard").applyInArrow(reduce, "shard int, words long, tokens long, documents long").collect()
    sizes = [0] * shards
    for r in made:
        sizes[r["shard"]] = r["words"]
    store = Store(uri)
    for k in set(range(shards)) - {r["shard"] for r in made}:
        store.save(f"words-{k}", np.empty(0, dtype="<u8"))
        store.save(f"counts-{k}", np.empty(0, dtype="<u8"))
    return model._replace(sizes=sizes, total=sum(r["tokens"] for r in made), documents=sum(r["documents"] for r in made))


def pair_ids(vocabulary: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context and word id of every token, tokens of each text, and the chunk's distinct ids with counts."""
    made, sizes = tokens(texts)
    unique, back = np.unique(made, return_inverse=True)
    known = vocabulary.ids(unique)
    ids = known[back]
    context = np.concatenate((np.zeros(1, dtype=np.int64), ids[:-1]))
    context[np.cumsum(sizes)[:-1]] = 0
    return context, ids, sizes, back, known


def _bigram_job(rows: DataFrame, model: Model) -> Model:
    shards, uri = model.shards, model.uri

    def count(batches):
        vocabulary = Vocabulary(model)
        held, size = [], 0

        def send():
            keys, n = merge(held)
            context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            own, back = np.unique(context, return_inverse=True)
            spread = ((vocabulary.count(own) >= model.wide_from()) | (own == 0))[back]
            place = shard_of(context, word, spread, model)
            order = np.argsort(place, kind="stable")
            keys, n, place = keys[order], n[order], place[order]
            cut = np.searchsorted(place, np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cut)).tolist()
            # contexts as steps, so that the shuffle's compression finds them
            step = lambda x: np.diff(x, prepend=x.dtype.type(0)).astype("<u4").tobytes()
            parts = [(keys[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]]) for k in used]
            return block(used, [step(x >> np.uint64(32)) for x, _ in parts], [(x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for x, _ in parts], [narrow(c) for _, c in parts])

        for _, texts in chunked(batches, 0):
            context, word, *_ = pair_ids(vocabulary, texts)
            held.append(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
            size += len(word)
            if size >= GATHER:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def reduce(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        keys, counts = [], []
        for a, b, c in zip(table.column("a"), table.column("b"), table.column("c"), strict=True):
            context = np.cumsum(np.frombuffer(a.as_py(), "<u4"), dtype=np.uint64)
            keys.append(context << np.uint64(32) | np.frombuffer(b.as_py(), "<u4").astype(np.uint64))
            counts.append(np.frombuffer(c.as_py(), "<u4"))
        keys, n = merge(keys, counts)
        del counts
        store = Store(uri)
        store.save(f"keys-{k}", keys)
        store.save(f"seen-{k}", np.minimum(n, 0xFFFFFFFF).astype("<u4"))
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        kinds = [np.add.reduceat(m.astype(np.int64), first) for m in (n == 1, n == 2, n >= 3)]
        own = context[first]
        store.save(f"contexts-{k}", own.astype("<u4"))
        store.save(f"kinds-{k}", np.stack(kinds, axis=1).astype("<u4"))
        vocabulary = Vocabulary(model)
        spread = (vocabulary.count(own) >= model.wide_from()) | (own == 0)
        wide = np.stack([own[spread], *[x[spread] for x in kinds]], axis=1).astype("<i8").tobytes()
        word, contexts = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        cut = np.searchsorted(word, np.concatenate((vocabulary.offsets[:-1] + 1, [1 << 32])).astype(np.uint64))
        used = np.flatnonzero(np.diff(cut)).tolist()
        made = block([-1, *used], [wide, *[word[cut[r] : cut[r + 1]].astype("<u4").tobytes() for r in used]], [np.array([(n == x).sum() for x in (1, 2, 3, 4)] + [len(n)], "<i8").tobytes(), *[narrow(contexts[cut[r] : cut[r + 1]]) for r in used]])
        return pa.Table.from_batches([made])

    sent = stage(workers(rows).mapInArrow(count, BLOCK).groupBy("shard").applyInArrow(reduce, BLOCK), "bigrams")
    kinds, wide = np.zeros(5, dtype=np.int64), {}
    for r in sent.where("shard = -1").select("a", "b").collect():
        kinds += np.frombuffer(r["b"], "<i8")
        for own, *n in np.frombuffer(r["a"], "<i8").reshape(-1, 4).tolist():
            wide[own] = tuple(x + y for x, y in zip(wide.get(own, (0, 0, 0)), n, strict=True))
    sizes = model.sizes
    offsets = np.concatenate(([0], np.cumsum(sizes)))

    def continuations(table: pa.Table) -> pa.Table:
        k = table.column("shard")[0].as_py()
        out = np.zeros(sizes[k], dtype="<u4")
        for a, b in zip(table.column("a"), table.column("b"), strict=True):
            out[np.frombuffer(a.as_py(), "<u4").astype(np.int64) - 1 - offsets[k]] += np.frombuffer(b.as_py(), "<u4")
        Store(uri).save(f"continuations-{k}", out)
        found = [int((out == x).sum()) for x in (1, 2, 3, 4)]
        return pa.table({"shard": pa.array([k], pa.int32()), **{f"n{x}": [n] for x, n in enumerate(found, 1)}, "more": [int((out >= 3).sum())]})

    made = sent.where("shard >= 0").groupBy("shard").applyInArrow(continuations, "shard int, n1 long, n2 long, n3 long, n4 long, more long").collect()
    store = Store(uri)
    for k in set(range(shards)) - {r["shard"] for r in made}:
        store.save(f"continuations-{k}", np.zeros(sizes[k], dtype="<u4"))
    low = [sum(r[f"n{x}"] for r in made) for x in (1, 2, 3, 4)]
    return model._replace(discounts=discounts(kinds[:4].tolist()), low_discounts=discounts(low), low_kinds=(low[0], low[1], sum(r["more"] for r in made)), bigrams=int(kinds[4]), wide=wide)


def train(documents: DataFrame, learn: Column, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the rows for which ``learn`` holds; the model's arrays lie in the shared folder."""
    spark = documents.sparkSession
    rows = documents.where(learn).select(F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(partitions(spark), math.ceil(size / shard_bytes))
    model = _vocabulary_job(rows, Model(work_dir(spark, "lm"), shards, [], 0, 0))
    if not model.total:
        return model
    if model.vocabulary >= 1 << 32:
        raise ValueError("word ids need more than 32 bits")
    return _bigram_job(rows, model)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model)
        store = Store(model.uri)
        if model.total:
            self.keys, self.seen, self.contexts, self.kinds, self.continuations = [], [], [], [], []
            for k in range(model.shards):
                self.keys.append(self._load(store, f"keys-{k}", "<u8"))
                self.seen.append(self._load(store, f"seen-{k}", "<u4"))
                self.contexts.append(self._load(store, f"contexts-{k}", "<u4"))
                self.kinds.append(self._load(store, f"kinds-{k}", "<u4").reshape(-1, 3))
                self.continuations.append(store.load(f"continuations-{k}", "<u4"))
            self.wide_ids = np.array(sorted(model.wide), dtype=np.int64)
            self.wide_kinds = np.array([model.wide[k] for k in sorted(model.wide)], dtype=np.int64).reshape(-1, 3)

    @staticmethod
    def _load(store: Store, name: str, kind: str) -> np.ndarray:
        """A shard that got no keys has no file."""
        try:
            return store.load(name, kind)
        except FileNotFoundError:
            return np.empty(0, dtype=kind)

    def low(self, ids: np.ndarray) -> np.ndarray:
        """p1 of sorted ids."""
        m = self.model
        if not m.total:
            return np.full(len(ids), 1.0)
        seen = np.zeros(len(ids))
        seen[ids > 0] = self.vocabulary.take(self.continuations, ids[ids > 0])
        spare = sum(d * n for d, n in zip(m.low_discounts, m.low_kinds, strict=True)) / m.bigrams
        return discounted(seen, m.low_discounts) / m.bigrams + spare / (m.vocabulary + 1)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and model score of each text."""
        m = self.model
        context, word, sizes, back, known = pair_ids(self.vocabulary, texts)
        order = np.argsort(known, kind="stable")
        count = np.empty(len(known), dtype=np.int64)
        low = np.empty(len(known))
        count[order], low[order] = self.vocabulary.count(known[order]), self.low(known[order])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        base = np.log10((count + 1) / (m.total + m.vocabulary + 1))[back]
        p1 = low[back]
        if m.total:
            key = (context + 1).astype(np.uint64) << np.uint64(32) | (word + 1).astype(np.uint64)
            pairs, at = np.unique(key, return_inverse=True)
            hit, rest = self.pairs((pairs >> np.uint64(32)).astype(np.int64) - 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1)
            p1 = hit[at] + rest[at] * p1
        score = np.log10(p1)
        total = lambda x: np.add.reduceat(x, first)
        return sizes, total((count[back] > 0).astype(np.int64)), total(base), total(score)

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probability of each pair and the weight of p1, for pairs in context order."""
        m = self.model
        own, back = np.unique(context, return_inverse=True)
        count = self.vocabulary.count(own)
        spread = (count >= m.wide_from()) | (own == 0)
        kinds = np.zeros((len(own), 3))
        wide = np.flatnonzero(spread)
        if len(wide):
            kinds[wide] = self.wide_kinds[np.searchsorted(self.wide_ids, own[wide])]
        home = own * m.shards // (m.vocabulary + 1)
        for k in range(m.shards):
            mine = np.flatnonzero((home == k) & (own > 0) & ~spread)
            if len(mine) and len(self.contexts[k]):
                at = np.minimum(np.searchsorted(self.contexts[k], own[mine]), len(self.contexts[k]) - 1)
                kinds[mine] = np.where((self.contexts[k][at] == own[mine])[:, None], self.kinds[k][at], 0)
        rest = np.where(count > 0, kinds @ np.array(m.discounts) / np.maximum(count, 1), 1.0)
        seen = np.zeros(len(context))
        known = (context >= 0) & (word > 0)
        place = np.where(known, shard_of(context, np.maximum(word, 0), spread[back], m), -1)
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(m.shards + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            mine = order[cut[k] : cut[k + 1]]
            keys = context[mine].astype(np.uint64) << np.uint64(32) | word[mine].astype(np.uint64)
            if len(self.keys[k]):
                at = np.minimum(np.searchsorted(self.keys[k], keys), len(self.keys[k]) - 1)
                seen[mine] = np.where(self.keys[k][at] == keys, self.seen[k][at], 0)
        return discounted(seen, m.discounts) / np.maximum(count, 1)[back], rest[back]


def discounted(seen: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    cut = np.array([0.0, *d])[np.minimum(seen, 3).astype(np.int64)]
    return np.maximum(seen - cut, 0)


OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(model)
        for part, texts in chunked(batches, 2):
            n, known, base, made = scorer.score(texts)
            columns = [part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, known, np.full(len(n), model.total))], pa.array(base, pa.float64()), pa.array(made, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", *[c.split()[0] for c in OUT.split(", ")]])

    rows = documents.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = workers(rows).mapInArrow(run, f"doc_id {id_type}, held_out boolean, {OUT}")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
