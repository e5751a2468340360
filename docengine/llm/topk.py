"""Exact top-k search by pivot elimination.

Every vector's distances to PIVOTS pivots are computed once. By the triangle inequality the largest difference between a
query's and a candidate's distances to a pivot bounds their own distance from below, and with the two lengths that
bounds their inner product from above. A query takes the candidates in order of that bound and stops as soon as the
next bound lies below its k-th best score; what is left cannot enter the result. Bounds get a slack above rounding
errors; scores are integers.

Queries and candidates are dealt into blocks, and each pair of blocks is one group of bounded size; a query's bests of
all candidate blocks are merged at the end. The number of blocks follows the counted rows. Pivots are the PIVOTS rows
with the smallest hashes of their ids, the only rows that go to the driver.

Vectors that are null or hold null or non-finite components, and rows without id, take no part. Rows that share an id are
rows of their own, each a candidate for the other, also if their vectors are equal; results name their id. Shorter vectors count as padded with zeros. Fewer than k candidates give fewer
rows; ties go to the smaller id. An empty table gives an empty table; additional columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import materialize, small

PIVOTS, SCALE = 32, 64
#: Rows in a block of queries and of candidates: at least, and at most.
QUERY_BLOCK, CANDIDATE_BLOCK = (1024, 16_384), (4096, 65_536)
#: Candidates that are scored before the bounds are looked at again.
STEP = 128

_BEST = "query_row long, query_id long, id long, score long"


def quantized(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def _prepared(table: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """id, is_query and the packed vector with its squared length and its distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = np.zeros((b.num_rows, width), np.float64)
            for i, v in enumerate(b.column(2).to_pylist()):
                x[i, : len(v)] = v
            d = np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(-1)) if len(pivots) else np.zeros((len(x), 0))
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, d)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed[0], pa.array((x * x).sum(1)), packed[1], b.column(3)], ["id", "is_query", "vector", "norm", "pivots", "row"])

    return table.mapInArrow(run, "id long, is_query boolean, vector binary, norm double, pivots binary, row long")


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact however large the components."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if most < (2.0**24 if x.dtype == np.float32 else 2.0**53):
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in x]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)


class Candidates:
    """A block of candidates: vectors, squared lengths, and the pivot table with one row per pivot.

    Vectors are held in single precision where that is exact for every product with the block's queries. The pivot table
    is in single precision; the slack of the bounds is above its rounding errors.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, near: np.ndarray, widest: float, rows: np.ndarray | None = None):
        exact = max(float(np.abs(x).max(initial=0)), 1.0) * max(widest, 1.0) * max(x.shape[1], 1) < 2.0**24
        self.ids, self.norms, self.exact, self.rows = ids, norms, exact, ids if rows is None else rows
        self.x = x.astype(np.float32) if exact else x
        self.table = np.ascontiguousarray(near.T, np.float32)
        self.length = float(norms.max(initial=0.0)) ** 0.5
        self.farthest = float(near.max(initial=0.0))

    def bounds(self, norm: float, to: np.ndarray) -> np.ndarray:
        """No inner product with a query of that squared length and those distances to the pivots is above its bound."""
        low, one = np.zeros(len(self.ids), np.float32), np.empty(len(self.ids), np.float32)
        for row, d in zip(self.table, to.astype(np.float32)):
            np.subtract(row, d, out=one)
            np.abs(one, out=one)
            np.maximum(low, one, out=low)
        bound = (self.norms + norm - low.astype(np.float64) ** 2) * 0.5
        length = self.length + norm**0.5
        return bound + (1e-6 * max(self.farthest, float(to.max(initial=0.0))) * length + 1e-9 * length * length + 1e-6)

    def best(self, own: int, q: np.ndarray, norm: float, to: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best for the query in the row own, and how many candidates were scored.

        The candidates with the highest bounds are scored first, STEP and then eight times as many at a time; those whose
        bound lies below the k-th best score so far are out for good.
        """
        bound, q = self.bounds(norm, to), q.astype(self.x.dtype)
        left = np.flatnonzero(self.rows != own)
        have_ids, have = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step, seen = STEP, 0
        while len(left):
            if len(left) > step:
                order = np.argpartition(-bound[left], step)
                part, left = left[order[:step]], left[order[step:]]
            else:
                part, left = left, left[:0]
            seen += len(part)
            x = self.x.take(part, axis=0)
            score = (x @ q).astype(np.int64) if self.exact else scores(x, q)
            if len(have) == k:
                good = score >= have[-1]
                part, score = part[good], score[good]
            elif len(score) > k:
                good = score >= np.partition(score, len(score) - k)[len(score) - k]
                part, score = part[good], score[good]
            have_ids, have = np.r_[have_ids, self.ids[part]], np.r_[have, score]
            first = np.lexsort((have_ids, -have))[:k]
            have_ids, have = have_ids[first], have[first]
            if len(have) == k:
                left = left[bound[left] >= have[-1]]
            step *= 8
        return have_ids, have, seen


def _cell(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("is_query").to_pylist(), bool)
        ids, rows = np.array(table.column("id").to_pylist(), np.int64), np.array(table.column("row").to_pylist(), np.int64)

        def packed(name: str) -> np.ndarray:
            rows = table.column(name).to_pylist()
            return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows and rows[0] else np.zeros((len(rows), 0))

        x, near, norms = packed("vector"), packed("pivots"), np.array(table.column("norm").to_pylist(), np.float64)
        there, out = ~is_query, ([], [], [], [])
        block = Candidates(ids[there], x[there], norms[there], near[there], float(np.abs(x[is_query]).max(initial=0)), rows[there])
        for i in np.flatnonzero(is_query):
            got, score, _ = block.best(rows[i], x[i], norms[i], near[i], k)
            out[0].append(np.full(len(got), rows[i]))
            out[1].append(np.full(len(got), ids[i]))
            out[2].append(got)
            out[3].append(score)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], ["query_row", "query_id", "id", "score"])

    return run


def blocks(rows: int, size: tuple[int, int], parts: int) -> int:
    """How many blocks rows are dealt into: of the smaller size while that makes no more than parts of them."""
    return max(1, math.ceil(rows / min(size[1], max(size[0], rows // parts))))


def search(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k highest inner products of each query with the other rows' vectors."""
    table = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantized(F.col(vector)).alias("v"))
    # rows that are alike in id and vector are numbered, so that each row has a name of its own
    table = table.groupBy("id", "v").agg(F.max("is_query").alias("is_query"), F.count(F.lit(1)).alias("n")).select("id", "is_query", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("n"))
    table = table.select("id", "is_query", "v", F.xxhash64("id", "v", "n").alias("row"))
    rows, queries, width = table.agg(F.count(F.lit(1)), F.count_if("is_query"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    chosen = table.orderBy(F.xxhash64("row"), "row").limit(PIVOTS).select("v").collect()
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r.v)] = r.v
    ready = materialize(_prepared(table, width, pivots))
    nq, nc = blocks(queries, QUERY_BLOCK, 16), blocks(rows, CANDIDATE_BLOCK, 64)
    mine = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(nq)).cast("int"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(nc)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    body = ("id", "vector", "norm", "pivots", "row")
    asks = ready.where("is_query").select(mine[0].alias("query_block"), every(nc).alias("candidate_block"), F.lit(True).alias("is_query"), *body)
    gives = ready.select(every(nq).alias("query_block"), mine[1].alias("candidate_block"), F.lit(False).alias("is_query"), *body)
    found = asks.unionByName(gives).groupBy("query_block", "candidate_block").applyInArrow(_cell(k), _BEST)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
