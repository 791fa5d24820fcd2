"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees, exact reranking.

The forest's hyperplanes are fitted on a bounded sample (`sample` rows, those with the smallest hash of the id); every row is then
indexed: it falls into one leaf of each tree. A query walks all trees at once: a queue holds the branches not taken, the one whose
hyperplane is nearest comes next, until a share of all leaves is visited. Queries and rows meet in the leaves (an equality grouping), and
what a leaf offers is scored by the exact cosine in double precision.

A leaf with many rows is cut into parts by a hash of the id, so that copies of one vector don't meet in one task; the query goes to every
part. Recall depends on `share`: vectors without any cluster structure need about half of all rows for a recall of 0.95.

Defined results: null ids, null or zero vectors, vectors with null or non-finite components and vectors of another length than most take
no part; equal scores go to the smaller id; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a leaf that one task holds, about.
PART = 4096


class Forest:
    """Trees as arrays: hyperplane, threshold and the two children of each inner node; a leaf is a negative child."""

    def __init__(self, x: np.ndarray, trees: int = 8, leaf: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.leaves = [], []
        for _ in range(trees):
            planes, bounds, kids, count = [], [], [], 0
            todo = [(np.arange(len(x)), -1, 0)]  # rows, parent, side
            while todo:
                rows, parent, side = todo.pop()
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x[rows] @ d
                cut = np.median(p) if len(rows) else 0.0
                right = p > cut
                if len(rows) <= leaf or not right.any():  # equal vectors can't be parted
                    count += 1
                    me = -count
                else:
                    me = len(planes)
                    planes.append(d.astype(np.float32))
                    bounds.append(float(cut))
                    kids.append([0, 0])
                    todo += [(rows[~right], me, 0), (rows[right], me, 1)]
                if parent >= 0:
                    kids[parent][side] = me
            self.trees.append((np.array(planes, np.float32).reshape(-1, x.shape[1]), np.array(bounds), np.array(kids, np.int64).reshape(-1, 2)))
            self.leaves.append(count)
        self.first = np.concatenate([[0], np.cumsum(self.leaves)])[:-1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered through all trees."""
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (planes, bounds, kids) in enumerate(self.trees):
            side = x @ planes.T.astype(np.float64) > bounds
            at = np.full(len(x), 0 if len(planes) else -1)
            while (live := np.flatnonzero(at >= 0)).size:
                at[live] = kids[at[live], side[live, at[live]].astype(np.int64)]
            out[:, t] = self.first[t] - at - 1
        return out

    def visits(self, v: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of the shared queue: the branch with the smallest worst distance to its hyperplanes first."""
        margins = [planes.astype(np.float64) @ v - bounds for planes, bounds, _ in self.trees]
        queue = [(0.0, t, 0 if len(m) else -1) for t, m in enumerate(margins)]
        out: list[int] = []
        while queue and len(out) < most:
            far, t, at = heapq.heappop(queue)
            while at >= 0:
                m, (left, right) = margins[t][at], self.trees[t][2][at]
                near, other = (right, left) if m > 0 else (left, right)
                heapq.heappush(queue, (max(far, abs(m)), t, int(other)))
                at = int(near)
            out.append(int(self.first[t] - at - 1))
        return out


def unit(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors divided by their length, as double."""
    good, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is None or not v or (dim is not None and len(v) != dim) or any(x is None for x in v):
            continue
        a = np.array(v, np.float64)
        if np.isfinite(a).all() and a.any():
            good.append(i)
            rows.append(a / np.linalg.norm(a))
    return np.array(good, np.int64), np.array(rows, np.float64).reshape(len(rows), -1 if rows else dim or 0)


def nearest(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of each query's k best rows, its own id left out; `queries` and `rows` are the original vectors."""
    qn, rn = np.sqrt((queries * queries).sum(1)), np.sqrt((rows * rows).sum(1))
    rough = (queries / qn[:, None]) @ (rows / rn[:, None]).T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for i, r in enumerate(rough):
        least = np.partition(r, -k)[-k] - 1e-9 if len(r) > k else -np.inf
        at = np.flatnonzero((r >= least) & (r > -np.inf))
        score = (rows[at] * queries[i]).sum(1) / (rn[at] * qn[i])  # summed alike wherever a row stands
        best = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(best), q_ids[i]), ids[at][best], score[best]))
    a, b, c = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, trees: int = 8, leaf: int = 32, sample: int = 16384, share: float = 0.13) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of every row whose id is divisible by `every`, among all other rows."""
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    ok = F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(ok)
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()  # the fit: bounded by `sample`
    empty = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if picked.empty:
        return empty
    dim = int(picked["v"].map(len).mode()[0])
    x = np.array([v for v in picked["v"] if len(v) == dim], np.float64)
    forest = Forest(x / np.linalg.norm(x, axis=1, keepdims=True), trees, leaf)
    most = max(trees, int(np.ceil(share * sum(forest.leaves))))
    rows = rows.where(F.size("v") == dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, u = unit(b.column(1), dim)
            if len(good):
                at = np.repeat(good, trees)
                yield pa.RecordBatch.from_arrays([pa.array(forest.cells(u).ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["cell", "id", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, u = unit(b.column(1), dim)
            for i, v in zip(good.tolist(), u):
                cells = forest.visits(v, most)
                at = pa.array([i] * len(cells), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column(0).take(at), b.column(1).take(at)], ["cell", "id", "v"])

    shape = "cell int, id long, v array<double>"
    spread = rows.repartition(max(vectors.sparkSession.sparkContext.defaultParallelism, 1))
    indexed = spread.mapInArrow(index, shape)
    asked = spread.where(F.col("id") % every == 0).mapInArrow(walk, shape)
    # rows of each leaf: as many numbers as the forest has leaves
    sizes = rows.select("id", "v").mapInArrow(index, shape).groupBy("cell").count().collect()
    parts = {r["cell"]: -(-r["count"] // PART) for r in sizes if r["count"] > PART}
    of = F.create_map([F.lit(x) for kv in parts.items() for x in kv])[F.col("cell")] if parts else F.lit(None).cast("int")
    n = F.coalesce(of, F.lit(1))
    indexed = indexed.withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))

    def rerank(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        plain = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        a, b, c = nearest(plain(queries), queries.column("id").to_numpy(), plain(found), found.column("id").to_numpy(), k)
        return pa.table({"query_id": a, "id": b, "score": c})

    met = asked.groupBy("cell", "part").cogroup(indexed.groupBy("cell", "part")).applyInArrow(rerank, "query_id long, id long, score double")
    best = met.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
