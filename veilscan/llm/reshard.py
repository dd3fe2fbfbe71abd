"""Resharding by minimum-cost flow: move the fewest bytes to reach new capacities.

Old shard sizes and new capacities form a transport problem: shipping a byte
from old shard i to new shard j costs 0 when the byte stays at home and 1 (or a
caller's price) when it moves. The flow says how many bytes go from i to j.
Rows are grouped into blocks inside their old shard (rows above a size
threshold each on their own, the others by a hash that counts the row's place in
its file, so repeated rows spread like others), and each old shard's blocks
are dealt, largest first, to the target with most flow left, so shard sizes
differ by about ``balance`` of a shard.

Only block totals reach the driver: at most 2 * shards / balance + old shards
of them, whatever the row count. Rows get their shard from that plan in one
map-side join, and their slot from a window inside a block (a bounded slice)
plus the block's base slot, so no shard passes through one task.

Defined cases: a null text has size 1; null ids are rows like others; repeated
rows keep all their copies, each with its own slot, and are spread over blocks; an empty table gives an
empty result; extra columns are carried by ``rewrite``, except
those named like the operator's own (``OWN``), which it replaces.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Blocks are at most this share of a new shard (a row may be larger on its own).
BALANCE = 1 / 256

#: Columns that the operator adds; extra input columns of these names are replaced.
OWN = {"old_shard", "buckets", "blk", "size", "text_crc32", "shard", "base", "slot"}
PLAN = T.StructType([T.StructField("old_shard", T.IntegerType()), T.StructField("blk", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def solve_transfers(sizes: list[int], capacities: list[int], prices: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Cheapest flow of all ``sizes`` into ``capacities``: {(old, new): bytes}.

    A byte costs 0 at home (old = new), its price on a priced pair, and 1
    elsewhere. Moves at the common price run over a hub, so the network has as
    many edges as shards and priced pairs; successive shortest paths solve it.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(sizes), len(capacities)
    if prices:
        return _successive_paths(sizes, capacities, {(i, j): prices.get((i, j), int(i != j)) for i in range(n) for j in range(m)})
    flow = _successive_paths(sizes, capacities, {(i, i): 0 for i in range(min(n, m))}, hub=1)
    # what runs over the hub leaves it in any order
    leaving = [[i, part] for (i, j), part in sorted(flow.items()) if j == m]
    made = {pair: part for pair, part in flow.items() if pair[0] < n and pair[1] < m}
    for (i, j), part in sorted(flow.items()):
        while i == n and part:
            step = min(part, leaving[-1][1])
            made[leaving[-1][0], j] = made.get((leaving[-1][0], j), 0) + step
            part -= step
            leaving[-1][1] -= step
            if not leaving[-1][1]:
                leaving.pop()
    return made


def _successive_paths(sizes, capacities, prices, hub: int | None = None):
    """Flow on the priced pairs; with ``hub`` also from old shards to the hub (pair (i, m), at that price) and on to new ones ((n, j), free)."""
    n, m = len(sizes), len(capacities)
    source, sink, centre = n + m, n + m + 1, n + m + 2
    edges: list[list[int]] = []  # to, room, cost
    named: dict[int, tuple[int, int]] = {}
    out: list[list[int]] = [[] for _ in range(n + m + 3)]

    def edge(a, b, room, cost):
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, size in enumerate(sizes):
        edge(source, i, size, 0)
        if hub is not None:
            named[len(edges)] = i, m
            edge(i, centre, size, hub)
    for (i, j), price in prices.items():
        named[len(edges)] = i, j
        edge(i, n + j, sizes[i], price)
    for j, room in enumerate(capacities):
        edge(n + j, sink, room, 0)
        if hub is not None:
            named[len(edges)] = n, j
            edge(centre, n + j, room, 0)
    height = [0] * (n + m + 3)
    left = sum(sizes)
    while left:
        dist, via, heap = [math.inf] * (n + m + 3), {}, [(0, source)]
        dist[source] = 0
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k in out[a]:
                b, room, cost = edges[k]
                if room and (far := d + cost + height[a] - height[b]) < dist[b]:
                    dist[b], via[b] = far, k
                    heapq.heappush(heap, (far, b))
        height = [h + (d if d < math.inf else 0) for h, d in zip(height, dist, strict=True)]
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = edges[via[b] ^ 1][0]
        part = min(left, *(edges[k][1] for k in path))
        for k in path:
            edges[k][1] -= part
            edges[k ^ 1][1] += part
        left -= part
    return {pair: sent for k, pair in named.items() if (sent := edges[k ^ 1][1])}


class Reshard(NamedTuple):
    flow: dict[tuple[int, int], int]
    plan: DataFrame  # old_shard, blk, shard, base
    rows: DataFrame  # the input with old_shard, size, text_crc32, blk
    moved: set[tuple[int, int]]  # (old, new) pairs that really carry rows


def size_of(text: Column) -> Column:
    return (F.octet_length(text_or_empty(text)) + F.lit(1)).cast("long")


def plan_reshard(rows: DataFrame, place_col: str, shards: int, id_col: str = "doc_id", text_col: str = "text", balance: float = BALANCE, prices: dict[tuple[int, int], int] | None = None, row_col: str | None = None) -> Reshard:
    """Plan the move of ``rows`` from their present places into ``shards`` shards of near-equal bytes.

    ``place_col`` names the file or folder a row lies in. Places in name order
    are the old shards; with more places than new shards, neighbouring places
    form one old shard, so old shard i is at home in new shard i. ``row_col``
    tells repeated rows of a place apart (a file's row number); without it the
    scan's running number does, which is the same in each job over the same files.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("row_no", F.monotonically_increasing_id() if row_col is None else F.col(row_col)).drop(*(OWN - {place_col, id_col, text_col}))
    text = text_or_empty(F.col(text_col))
    sized = rows.withColumns({"size": size_of(F.col(text_col)), "text_crc32": F.crc32(text.cast("binary"))})
    places = sorted((r[0] or "", r[1]) for r in sized.groupBy(place_col).agg(F.sum("size")).collect())
    n_old = min(len(places), shards)
    old_of = {p: k * n_old // len(places) for k, (p, _) in enumerate(places)}
    sizes = [0] * n_old
    for p, size in places:
        sizes[old_of[p]] += size
    total = sum(sizes)
    capacities = equal_capacities(total, shards)
    flow = solve_transfers(sizes, capacities, prices)
    limit = max(1, int(balance * total / shards))
    buckets = [max(1, math.ceil(s / limit)) for s in sizes]
    # one row a place; no hint, so it is broadcast only where its measured size allows
    lookup = spark.createDataFrame([(p, old_of[p], buckets[old_of[p]]) for p, _ in places], f"`{place_col}` string, old_shard int, buckets int")
    placed = sized.withColumn(place_col, F.coalesce(F.col(place_col), F.lit(""))).join(lookup, place_col)
    key = F.xxhash64(F.col(id_col), F.col("text_crc32"), F.col(place_col), F.col("row_no"))
    blk = F.when(F.col("size") >= limit, key).otherwise(F.pmod(key, F.col("buckets").cast("long")))
    placed = placed.withColumn("blk", blk).drop("buckets", "row_no", place_col)
    blocks = placed.groupBy("old_shard", "blk").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    target = _deal(blocks, flow)
    base = [0] * shards
    plan = []
    for b in sorted(blocks, key=lambda b: (b["old_shard"], b["blk"])):
        j = target[b["old_shard"], b["blk"]]
        plan.append((b["old_shard"], b["blk"], j, base[j]))
        base[j] += b["rows"]
    return Reshard(flow, spark.createDataFrame(plan, PLAN), placed, {(i, j) for i, _, j, _ in plan if i != j})


def _deal(blocks, flow) -> dict[tuple[int, int], int]:
    """Blocks of an old shard, largest first, each to the new shard with most flow left."""
    heaps: dict[int, list] = {}
    for (i, j), part in flow.items():
        heaps.setdefault(i, []).append((-part, i != j, j))
    for heap in heaps.values():
        heapq.heapify(heap)
    out = {}
    for b in sorted(blocks, key=lambda b: (-b["bytes"], b["old_shard"], b["blk"])):
        heap = heaps[b["old_shard"]]
        part, away, j = heap[0]
        out[b["old_shard"], b["blk"]] = j
        heapq.heapreplace(heap, (part + b["bytes"], away, j))
    return out


def assign(made: Reshard) -> DataFrame:
    """The rows with ``shard`` and the block's ``base`` slot; map-side (the plan is bounded)."""
    return made.rows.join(F.broadcast(made.plan), ["old_shard", "blk"])


def with_slots(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``slot`` numbers each shard's rows from 0 without gaps."""
    inside = Window.partitionBy("old_shard", "blk").orderBy(id_col, "text_crc32", "size")
    return assigned.withColumn("slot", F.col("base") + F.row_number().over(inside) - 1)


def rewrite(made: Reshard, out_dir: str) -> list[int]:
    """Write the new content of every shard that gains or loses rows under ``out_dir/shard=j``.

    Shards without a transfer are not touched; returns the shards written.
    """
    touched = sorted({k for pair in made.moved for k in pair})
    rows = assign(made).where(F.col("shard").isin(touched)) if touched else assign(made).limit(0)
    rows.drop("old_shard", "blk", "base", "size", "text_crc32").write.partitionBy("shard").parquet(out_dir)
    return touched
