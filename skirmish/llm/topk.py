"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are whole numbers, floor(``scale`` x component). Candidates are dealt over
blocks, queries over groups; each pair of a block and a group is a task's work. A
block keeps its vectors sorted by every dimension. A query walks all lists at
once, from the end that adds most to its score, scores the vectors it meets for
the first time, and stops when no vector further down can beat its kth result:
the sum of the products at the present depth is below that score. The k best of
each block then meet in one ranking per query.

Inner products are exact: they use doubles while every partial sum stays below
2^53, and Python's whole numbers beyond.

Defined results: vectors that are null, have a null or non-finite component take
no part; a query's own row (same id) is no candidate; ties go to the smaller id;
rows that repeat an id are candidates each. Vectors of unequal size score over the
shorter size. Ids that are null take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 8192
GROUP = 2048
_EXACT = 2**53


def quantized(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): whole components of the vectors that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
    finite = F.forall(F.col(embedding), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return vectors.where(usable & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [np.asarray(x.values) for x in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Block:
    """Vectors and their order in every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable").T.copy()
        self.ordered = np.take_along_axis(self.vectors, self.lists.T, axis=0).T.copy()
        self.top = int(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)

    def best(self, query: np.ndarray, own: int, k: int, step: int = 64) -> tuple[np.ndarray, list]:
        """Ids and scores of the k best, better ones first."""
        size = min(len(query), self.vectors.shape[1])
        query = query[:size]
        exact = sum(abs(int(q)) for q in query) * self.top < _EXACT
        dims = np.flatnonzero(query)
        n, depth, deeper = len(self.ids), 0, step
        seen = np.zeros(n, bool)
        got_at, got = np.zeros(0, np.int64), np.zeros(0, np.float64 if exact else object)
        while True:
            if len(dims):
                fresh = np.zeros(n, bool)
                for d in dims:
                    fresh[self.lists[d, depth:deeper] if query[d] > 0 else self.lists[d, max(n - deeper, 0) : n - depth]] = True
                fresh &= ~seen
            else:
                fresh = ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != own]
            if len(at):
                if exact:
                    scores = self.floats[at, :size] @ query.astype(np.float64)
                else:
                    scores = self.vectors[at, :size].astype(object) @ query.astype(object)
                got_at, got = np.concatenate([got_at, at]), np.concatenate([got, scores])
                if len(got) > k:
                    order = np.lexsort((self.ids[got_at], -got)) if exact else np.array(sorted(range(len(got)), key=lambda i: (-got[i], self.ids[got_at[i]])))
                    got_at, got = got_at[order[:k]], got[order[:k]]
            depth = deeper
            if depth >= n or not len(dims):
                break
            if len(got) == k:
                edge = np.where(query[dims] > 0, self.ordered[dims, depth - 1], self.ordered[dims, n - depth])
                bound = sum(int(a) * int(b) for a, b in zip(query[dims], edge, strict=True))
                if bound < got[-1]:  # a vector further down may equal the bound and win by its id
                    break
            deeper = min(n, deeper * 2)
        order = sorted(range(len(got)), key=lambda i: (-got[i], self.ids[got_at[i]]))
        return self.ids[got_at[order]], [int(got[i]) for i in order]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates; both sides are (vec_id, v)."""
    sizes = [candidates.count(), queries.count()]
    blocks, groups = max(1, -(-sizes[0] // block)), max(1, -(-sizes[1] // group))
    spread = F.xxhash64("vec_id", "v")
    left = queries.select(F.pmod(spread, F.lit(groups)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "vec_id", "v")
    right = candidates.select(F.pmod(F.xxhash64(spread, F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "vec_id", "v")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if asked.num_rows and held.num_rows:
            table = Block(held.column("vec_id").to_numpy(), _matrix(held.column("v")))
            for query, v in zip(asked.column("vec_id").to_pylist(), _matrix(asked.column("v")), strict=True):
                near, scores = table.best(v, query, k)
                found += [(query, a, s) for a, s in zip(near.tolist(), scores, strict=True)]
        return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    pairs = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
