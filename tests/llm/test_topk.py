import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine.llm import topk
from docengine.llm.queries import op5_topk


def plain(rows, asks, k):
    vectors = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.append((key, [math.floor(64.0 * x) for x in v]))
    out = []
    for i, (a, q) in enumerate(vectors):
        if asks(a):
            found = sorted((-sum(x * y for x, y in zip(q, v)), b) for j, (b, v) in enumerate(vectors) if j != i)[:k]
            out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(found)]
    return sorted(out)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op5_topk(spark, sf_dir).collect())
    assert got == plain(rows, lambda a: a % 20 == 0, 20)


@pytest.mark.parametrize("small", [False, True])
def test_ties_blocks_and_edges(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "QUERY_BLOCK", (3, 5))
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", (7, 11))
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 16]) for i in range(150)]
    rows += [(0, rows[0][1]), (5, [2.0] * 6), (5, [0.5] * 6), (7, [1.0] * 6), (200, None), (201, [float("nan")] * 6), (202, [None] * 6), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (205, []), (206, [0.5, 0.5])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, score int, id int")
    got = sorted(tuple(r) for r in topk.search(df.drop("id"), F.col("vec_id") % 5 == 0, 4).collect())
    assert got == plain(rows, lambda a: a % 5 == 0, 4)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], kind), F.lit(True), 3).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0])], kind), F.lit(True), 3).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0]), (2, [3.0])], kind), F.lit(True), 3).count() == 2


def test_bounds_stop_the_search():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16)) * 40
    x = np.floor(centre[rng.integers(0, 20, 8000)] + rng.normal(size=(8000, 16)))
    pivots = x[:32]
    near = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(-1))
    ids, norms = np.arange(8000), (x * x).sum(1)
    got, score, seen = topk.Candidates(ids, x, norms, near, np.abs(x).max()).best(5, x[5], norms[5], near[5], 10)
    exact = np.lexsort((ids, -(x @ x[5])))
    assert list(got) == [i for i in exact if i != 5][:10]
    assert seen < 8000


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1, 40, 10_000):
        x = np.floor(rng.normal(size=(500, 8)) * scale)
        near = np.sqrt(((x[:, None] - x[None, :32]) ** 2).sum(-1))
        block = topk.Candidates(np.arange(500), x, (x * x).sum(1), near, np.abs(x).max())
        for i in range(0, 500, 7):
            assert (block.bounds((x[i] * x[i]).sum(), near[i]) >= x @ x[i]).all()


def test_large_components_are_exact():
    x = np.array([[2.0**30, 3.0], [2.0**30, 1.0]])
    assert list(topk.scores(x, np.array([2.0**30, 1.0]))) == [2**60 + 3, 2**60 + 1]
