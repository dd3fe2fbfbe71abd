"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are collapsed to their distinct values first, so copies cost one
node. For at most ``bits`` differing bits, 64 bits cut into ``bits + 2`` pieces
leave two pieces that agree exactly; every pair of pieces therefore gives a
key, and linked fingerprints meet under at least one key. A key with very many
members is cut again by the same argument over the bits outside it.

Inside a task the members of each key form a hierarchical index: they are
sorted by Gray rank, so members that agree on an upper bit pattern are
neighbours; each level's nodes factor out the next ``LEVEL_BITS`` shared bits.
The index is joined with itself from the top: the differences of two nodes'
patterns are added to those of their parents, and a pair whose sum exceeds the
limit is pruned with everything below it. Each task keeps a spanning forest of
its links, so a dense group sends on fewer links than it has members.

Components come from alternating large-star and small-star rounds over the link
table, each round staged in the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; repeated rows stay; a null id is never a component id unless a
component has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, workers

SHINGLE = 3
BITS = 2
SEED = 42
LEVEL_BITS = 8
#: Members of one key beyond which it is cut by further pieces.
HOT_KEY = 50_000
#: Node pairs that are compared at once in a task.
PAIR_CHUNK = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit majority fingerprint of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row."""
    id_type = documents.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return workers(rows).mapInArrow(run, f"doc_id {id_type.simpleString()}, fp long")


def pieces(width: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` near-equal pieces of ``width`` bits."""
    edges = [width * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def key_masks(bits: int) -> list[int]:
    """Masks of two out of ``bits + 2`` pieces: linked values agree under at least one."""
    cut = [((1 << w) - 1) << s for s, w in pieces(64, bits + 2)]
    return [a | b for a, b in combinations(cut, 2)]


def sub_masks(mask: int, bits: int) -> list[int]:
    """``bits + 1`` pieces of the bits outside ``mask``: linked values agree on at least one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << free[i] for i in range(s, s + w)) for s, w in pieces(len(free), bits + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in Gray code order (prefix exclusive-or of its bits)."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def linked_pairs(group: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of distinct values in the same group that differ in at most ``bits`` bits.

    ``group`` is any integer label; returns positions into the index's sorted
    order together with that order: (values_a, values_b).
    """
    order = np.lexsort((gray_rank(values), group))
    group, values = group[order], values[order]
    n = len(values)
    if n < 2:
        return values[:0], values[:0]
    # levels[l]: first member of each node; kids[l]: first child in level l + 1 of each node
    same_group = np.concatenate(([False], group[1:] == group[:-1]))
    levels, masks = [np.flatnonzero(~same_group)], []
    for top in range(LEVEL_BITS, 65, LEVEL_BITS):
        shift = np.uint64(64 - top)
        prefix = values >> shift
        levels.append(np.flatnonzero(~(same_group & np.concatenate(([False], prefix[1:] == prefix[:-1])))))
        masks.append(np.uint64(((1 << LEVEL_BITS) - 1) << (64 - top)))
    kids = [np.searchsorted(low, np.append(up, n)) for up, low in zip(levels, levels[1:], strict=False)]
    found_a, found_b = [], []
    roots = np.arange(len(levels[0]))
    todo = [(0, roots, roots, np.zeros(len(roots), dtype=np.uint8))]
    while todo:
        level, a, b, spent = todo.pop()
        if level == len(masks):
            apart = a != b
            found_a.append(levels[level][a[apart]])
            found_b.append(levels[level][b[apart]])
            continue
        first = kids[level]
        wide_a, wide_b = first[a + 1] - first[a], first[b + 1] - first[b]
        many = wide_a * wide_b
        if many.sum() > PAIR_CHUNK and len(a) > 1:
            half = len(a) // 2
            todo += [(level, a[:half], b[:half], spent[:half]), (level, a[half:], b[half:], spent[half:])]
            continue
        at = np.repeat(np.arange(len(a)), many)
        step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        kid_a, kid_b = first[a][at] + step // wide_b[at], first[b][at] + step % wide_b[at]
        keep = kid_a <= kid_b  # a node meets itself once
        kid_a, kid_b, at = kid_a[keep], kid_b[keep], at[keep]
        low = levels[level + 1]
        apart = (values[low[kid_a]] ^ values[low[kid_b]]) & masks[level]
        total = spent[at] + np.bitwise_count(apart)
        near = total <= bits
        if near.any():
            todo.append((level + 1, kid_a[near], kid_b[near], total[near]))
    if not found_a:
        return values[:0], values[:0]
    return values[np.concatenate(found_a)], values[np.concatenate(found_b)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for every member of the components of the links, roots left out."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def links(nodes: DataFrame, bits: int = BITS, hot_key: int = HOT_KEY) -> DataFrame:
    """(u, v) links that connect the same distinct ``fp`` values as all pairs within ``bits`` would."""
    masks = key_masks(bits)
    keyed = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(keyed).alias("x")).select("fp", "x.k", "x.key")
    hot = stage(rows.groupBy("k", "key").count().where(F.col("count") > hot_key).select("k", "key", F.lit(True).alias("hot")), "hot")
    none = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("sub")))
    if hot.take(1):
        cut = none
        for k, m in enumerate(masks):
            parts = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("sub")) for s, x in enumerate(sub_masks(m, bits))])
            cut = F.when(F.col("hot") & (F.col("k") == k), parts).otherwise(cut)
        rows = rows.join(hot, ["k", "key"], "left")
    else:
        cut = none
    rows = rows.select("fp", "k", "key", F.explode(cut).alias("y")).select("fp", "k", "key", "y.s", "y.sub")
    group = F.xxhash64("k", "key", "s", "sub").alias("g")

    def run(batches: Iterator[pa.RecordBatch]):
        fps, groups = [], []
        for batch in batches:
            fps.append(batch.column(0).to_numpy(zero_copy_only=False))
            groups.append(batch.column(1).to_numpy(zero_copy_only=False))
        if not fps:
            return
        a, b = linked_pairs(np.concatenate(groups), np.concatenate(fps).view(np.uint64), bits)
        u, v = forest(a.view(np.int64), b.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # groups that share a hash only meet without need: every pair is compared bit by bit
    return workers(rows).select("fp", group).repartition("g").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of the link table; root is the smallest node reachable."""
    edges = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stage(small, "round")
        # the same number of links and the same sum of hashes: nothing changed
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most ``bits`` bits)."""
    marked = stage(fingerprints(documents, id_col, text_col, shingle), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, bits))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
