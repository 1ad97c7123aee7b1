"""Exact top-k inner products with a pivot table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import stash

PIVOTS = 24
#: Rows among which the pivots are chosen, and bytes of queries that one pass over the index takes.
PIVOT_SAMPLE, QUERY_BYTES = 512, 16 << 20
#: Candidates scored between two looks at the stopping bound.
STEP = 256


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and the vector as longs, floor(scale * x); vectors that are null or hold a null or non-finite component go."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def spread_out(sample: list[list[int]], n: int) -> dict[int, np.ndarray]:
    """For each dimension of the sample up to n pivots, each as far as can be from those before it."""
    pivots = {}
    for dim in {len(v) for v in sample if v}:
        x = np.unique(np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim), axis=0)
        chosen, gap = [], ((x - x.mean(0)) ** 2).sum(1)
        while len(chosen) < min(n, len(x)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap if len(chosen) > 1 else np.inf, ((x - x[chosen[-1]]) ** 2).sum(1))
        pivots[dim] = x[chosen]
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T), 0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("v").value_lengths().to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _table(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_dim(batch):
            x = _vectors(part.column("v"), dim).astype(np.float64)
            d = distances(x, pivots[dim]) if dim in pivots else np.zeros((len(x), 0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel(), pa.float64()))
            yield pa.record_batch([part.column("vec_id"), part.column("v"), flat, pa.array((x**2).sum(1), pa.float64())], names=["vec_id", "v", "to_pivots", "norm2"])


class Best:
    """The k best (score, vec_id) of one query so far, over all batches of a task; ties go to the smaller vec_id."""

    def __init__(self, number: int, own: int, v: np.ndarray, to_pivots: np.ndarray, norm2: float, k: int):
        self.number, self.own, self.v, self.to_pivots, self.norm2, self.k = number, own, v, to_pivots, norm2, k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, norm2: np.ndarray) -> int:
        """Take in the batch's rows but the query's own id; returns how many were scored.

        |q - x| is at least the largest difference of their distances to a pivot, so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2
        has an upper bound. In the order of bounds, scoring stops when the next bound is below the k-th score of all batches
        so far; the slack covers rounding. A bound equal to it is still scored, for its id may be smaller.
        """
        gap = np.abs(table - self.to_pivots).max(1) if table.shape[1] else np.zeros(len(ids))
        bound = (self.norm2 + norm2 - gap**2) / 2 * (1 + 1e-9) + 1e-6 * (self.norm2 + norm2 + 1)
        open_ = np.flatnonzero(bound >= self.scores[-1]) if len(self.scores) == self.k else np.arange(len(ids))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        scored = 0
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(self.scores) == self.k and bound[part[0]] < self.scores[-1]:
                break
            scored += len(part)
            part = part[ids[part] != self.own]
            s = np.concatenate((self.scores, (x[part] @ self.v.astype(x.dtype)).astype(np.int64)))
            i = np.concatenate((self.ids, ids[part]))
            top = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[top], i[top]
        return scored


def _search(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    block, largest_query = queries.value
    found = {dim: [Best(*query, k) for query in of] for dim, of in block.items()}
    for batch in batches:
        for dim, part in _by_dim(batch):
            x = _vectors(part.column("v"), dim)
            ids, norm2 = part.column("vec_id").to_numpy(), part.column("norm2").to_numpy()
            table = part.column("to_pivots").flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
            largest = max(np.abs(x).max(initial=0), largest_query)
            x = x.astype(np.float64) if dim * float(largest) ** 2 < 2**52 else x
            for query in found.get(dim, ()):
                query.meet(ids, x, table, norm2)
    for of in found.values():
        for q in of:
            n = len(q.ids)
            yield pa.record_batch([pa.array([q.number] * n, pa.int64()), pa.array([q.own] * n, pa.int64()), pa.array(q.ids), pa.array(q.scores)], names=["number", "query_id", "vec_id", "score"])


def _blocks(asked: DataFrame) -> Iterator[tuple[dict[int, list], int]]:
    """Queries numbered and grouped by dimension, in blocks of QUERY_BYTES at most, one at a time."""
    block: dict[int, list] = {}
    largest = held = 0
    for number, r in enumerate(asked.toLocalIterator()):
        v = np.array(r["v"], np.int64)
        block.setdefault(len(v), []).append((number, r["vec_id"], v, np.array(r["to_pivots"]), r["norm2"]))
        largest, held = max(largest, int(np.abs(v).max(initial=0))), held + 8 * (len(v) + len(r["to_pivots"])) + 200
        if held >= QUERY_BYTES:
            yield block, largest
            block, largest, held = {}, 0, 0
    if block:
        yield block, largest


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query over all rows but its own id.

    `queries` (vec_id, embedding) is by default every row whose vec_id `every` divides. The index holds every vector with its
    distances to `pivots` vectors, chosen in a bounded sample; the choice changes speed, never a result. Queries are
    numbered and go in blocks of QUERY_BYTES, broadcast one after the other; each task keeps a block's best so far over all
    its rows, which eliminates more with each batch, and a window joins the tasks' k best by query number.

    Ties go to the smaller vec_id. Vectors null or holding null or non-finite components, or without vec_id, take no
    part; those of another length than the query's are not scored. Repeated rows each count, as candidates and as
    queries: a query row that occurs twice has its k ranks twice. Scores beyond 63 bits are
    not defined. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors)
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect()]
    chosen = spread_out(sample, pivots)
    index = stash(rows.mapInArrow(lambda it: _table(it, chosen), "vec_id long, v array<long>, to_pivots array<double>, norm2 double"))
    asked = index.where(F.col("vec_id") % every == 0) if queries is None else quantised(queries).mapInArrow(lambda it: _table(it, chosen), index.schema)
    best_first = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id"))

    def answered(block: tuple) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)
        near = index.mapInArrow(lambda it: _search(it, shared, k), "number long, query_id long, vec_id long, score long")
        return near.withColumn("rank", best_first).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    out, before = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), None
    for block in _blocks(asked):
        # what a block found is written before the next one is searched: the plan doesn't grow, and a lost executor costs one block
        out = out if before is None else out.unionByName(stash(answered(before)))
        before = block
    return out if before is None else out.unionByName(answered(before))
