"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Largest inner product is turned into smallest distance: with M the largest
norm, a vector x gets the extra coordinate sqrt(M^2 - |x|^2) and a query q,
scaled to length M, a zero, so |x - q|^2 = 2 M^2 - 2 x.q. The vectors of a block
fall into bands by norm, each with its own M, so the extra coordinate stays
small whatever the longest vector is; a band whose M is below a query's k-th
best score is left out. Vectors are projected to ``M_DIMS`` dimensions by
Gaussian (2-stable) directions and a kd-tree is built over the projections of
each band. A query takes the tree's leaves in the order of
their projected distance and verifies their vectors. For a vector at true
distance d the squared projected distance over d^2 follows chi-square with
``M_DIMS`` degrees, so with r the next leaf's projected distance and d the
k-th best distance, the search stops once chi2((r / d)^2) reaches ``CONFIDENCE``:
a nearer vector lies beyond r with a chance of 1 - ``CONFIDENCE`` at most. All vectors
share the extra coordinate's direction, so it is not left to chance: its squared
length is ``M_DIMS``, the mean.

Vectors and queries are dealt to blocks by hash; every query block meets every
vector block in a task of its own, and each gives its k best, so a hot vector
or cluster makes no task larger. Block sizes are bounded by ``BLOCK_ROWS`` and
``QUERY_ROWS``; smaller tables are cut finer for the sake of all cores. All
vectors are indexed, and scores are inner products of the original vectors in
double precision.

Defined cases: rows without an id, and vectors that are null, zero, of another
length than most, or that hold a null or non-finite component take no part; equal scores go to the
smaller id; repeated rows count as they occur, apart from a query's own id;
fewer than k candidates give all; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import workers

M_DIMS = 8
CONFIDENCE = 0.95
#: Smallest norm in a band over its largest.
BAND = 0.9
LEAF = 16
#: Leaves that a query verifies between two stopping tests.
STEP = 32
#: Queries that are searched together in a task.
BATCH = 128
BLOCK_ROWS = 1 << 18
#: Bytes of the vectors in a block at most (as doubles).
BLOCK_BYTES = 1 << 26
QUERY_ROWS = 1 << 16
SEED = 20
SCHEMA = "query_id long, vec_id long, score double"


def chi2_cdf(x: np.ndarray, degrees: int = M_DIMS) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees."""
    half = np.maximum(x, 0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def directions(dims: int) -> np.ndarray:
    """Directions of the vectors' coordinates, and of the extra one as last row."""
    way = np.random.default_rng(SEED).standard_normal((dims + 1, M_DIMS))
    way[dims] *= math.sqrt(M_DIMS / (way[dims] @ way[dims]))
    return way


class Tree:
    """Leaves of a kd-tree over projected points: member order, leaf edges, bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        edges = [0]
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                edges.append(b)
                continue
            own = self.order[a:b]
            part = points[own]
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            half = (b - a) // 2
            self.order[a:b] = own[np.argpartition(part[:, axis], half)]
            todo += [(a + half, b), (a, a + half)]  # the left part is cut first, so edges ascend
        self.edges = np.array(edges)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.edges[:-1], axis=0)
        self.high = np.maximum.reduceat(sorted_points, self.edges[:-1], axis=0)

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.low)))
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0)
            out += gap * gap
        return out


class Band:
    """Vectors of similar norm: ``rows`` of the block in leaf order, each leaf's places in them, the largest norm."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, norms: np.ndarray, way: np.ndarray):
        self.top = float(norms.max()) * (1 + 1e-9)
        lift = np.sqrt(np.maximum(self.top**2 - norms**2, 0))
        self.tree = Tree(vectors @ way[:-1] + lift[:, None] * way[-1])
        self.rows = rows[self.tree.order]
        self.laid = vectors[self.tree.order]
        edges = self.tree.edges
        member = edges[:-1, None] + np.arange(int((edges[1:] - edges[:-1]).max()))
        self.filled = member < edges[1:, None]
        self.member = np.where(self.filled, member, 0)


def bands(vectors: np.ndarray, way: np.ndarray) -> list[Band]:
    """The vectors by norm, longest first; a band's norms differ by a factor of ``BAND`` at most."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    kind = np.floor(np.log(norms.max() / norms) / -math.log(BAND) + 1e-6).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    cuts = np.flatnonzero(np.diff(kind[order])) + 1
    return [Band(rows, vectors[rows], norms[rows], way) for rows in np.split(order, cuts)]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query_id, vec_id, score) of each query's k nearest found, and the number of verified pairs."""
    way = directions(vectors.shape[1])
    vectors, first, ids = classes(ids, np.ascontiguousarray(vectors, dtype=np.float64))
    parts = bands(vectors, way)
    spare = k + 12  # classes kept beside the k, as products of unit and original queries may round differently
    out, verified = [], 0
    for at in range(0, len(queries), BATCH):
        own, q = query_ids[at : at + BATCH], queries[at : at + BATCH].astype(np.float64)
        unit = q / np.sqrt((q * q).sum(axis=1))[:, None]
        column, projected = unit[:, :, None], unit @ way[:-1]
        best = np.full((len(q), spare), -np.inf)
        best_at = np.full((len(q), spare), -1, dtype=np.int64)

        def kth(rows: np.ndarray, best=best) -> np.ndarray:
            # the query's own class may be among the first k, so one more is asked for
            return np.partition(best[rows], spare - k - 1, axis=1)[:, spare - k - 1]

        for band in parts:
            live = np.flatnonzero(kth(np.arange(len(q))) <= band.top * (1 + 1e-6))
            if not len(live):
                break  # the bands to come are shorter
            far = np.full((len(q), len(band.member)), np.inf)
            far[live] = band.tree.distances(projected[live] * band.top)
            turn = np.argsort(far, axis=1)
            far = np.take_along_axis(far, turn, axis=1)
            for leaf in range(0, turn.shape[1], STEP):
                if leaf:
                    near = 2 * band.top * (band.top - kth(live))
                    ratio = np.where(np.isfinite(near), far[live, leaf] / np.maximum(near, 1e-12 * band.top**2), 0)
                    live = live[chi2_cdf(ratio) < confidence]
                    if not len(live):
                        break
                leaves = turn[live, leaf : leaf + STEP]
                rows = band.member[leaves].reshape(len(live), -1)
                there = band.filled[leaves].reshape(len(live), -1)
                verified += int(there.sum())
                score = np.where(there, np.matmul(band.laid[rows], column[live])[:, :, 0], -np.inf)
                score = np.concatenate((best[live], score), axis=1)
                where = np.concatenate((best_at[live], np.where(there, band.rows[rows], -1)), axis=1)
                pick = np.argpartition(-score, spare - 1, axis=1)[:, :spare]
                best[live] = np.take_along_axis(score, pick, axis=1)
                best_at[live] = np.take_along_axis(where, pick, axis=1)
        got = best_at >= 0
        row, found = np.nonzero(got)[0], best_at[got]
        exact = (vectors[found] * q[row]).sum(axis=1)
        # a class gives its k + 1 smallest ids: no more of them can be among a query's k nearest
        many = np.minimum(first[found + 1] - first[found], k + 1)
        row, exact = np.repeat(row, many), np.repeat(exact, many)
        one = ids[np.repeat(first[found], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        other = one != own[row]
        row, exact, one = row[other], exact[other], one[other]
        order = np.lexsort((one, -exact, row))
        row, one, exact = row[order], one[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((own[row[keep]], one[keep], exact[keep]))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, c, verified


def classes(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, and the ids of each in ascending order: ids[first[c] : first[c + 1]]."""
    raw = vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, at, label = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, label))
    return vectors[at], np.searchsorted(label[order], np.arange(len(at) + 1)), ids[order]


def valid(vector: str) -> str:
    """SQL condition: a non-zero vector of finite components."""
    return f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)"


def _array(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def nearest(table: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all rows but its own id."""
    spark = table.sparkSession

    def rows(df):
        kept = df.where(F.col(id_col).isNotNull() & F.expr(valid(f"`{vector_col}`")))
        return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))

    base, asked = rows(table), rows(queries)
    shapes = base.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).collect()
    if not shapes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = max(shapes, key=lambda r: (r["n"], -r["dims"]))
    base, asked = (df.where(F.size("vector") == shape["dims"]) for df in (base, asked))
    n, n_asked = shape["n"], asked.count()
    cores = 2 * spark.sparkContext.defaultParallelism
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * shape["dims"])))
    blocks = max(math.ceil(n / block_rows), min(cores, math.ceil(n / 2048)))
    groups = max(1, math.ceil(n_asked / query_rows))
    deal = lambda count, salt: F.pmod(F.xxhash64("vec_id", "vector", F.lit(salt)), F.lit(count)).cast("int")
    left = base.withColumn("b", deal(blocks, "b")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", deal(groups, "g")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b, c, _ = search(*_array(left), *_array(right), k, confidence)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = workers(left).groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(run, SCHEMA)
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
