import math
import os
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import docs, edge_docs

from docengine.llm import toxicity
from docengine.llm.queries import op7_toxicity

LARGER = "/root/testdata/sf0.1"


def rows_of(rng, n):
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randrange(5, 40))]
        y = int(rng.random() < 0.25)
        if y:
            words.insert(rng.randrange(len(words)), rng.choice(["zonkwort", "zonkoid", "qrumple"]))
        texts.append(" ".join(words))
        labels.append((i, y))
    return texts, labels


@pytest.fixture(scope="module")
def fitted(spark):
    texts, labels = rows_of(random.Random(3), 400)
    df = docs(spark, texts)
    return texts, labels, df, toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))


def dense(index):
    """The examples' vectors, read back from the postings, whose largest weights are checked on the way."""
    held = np.zeros((len(index.keys), len(index.idf)))
    for t in range(len(index.idf)):
        for c in range(index.term_start[t], index.term_start[t + 1]):
            places = slice(index.cell_start[c], index.cell_start[c + 1])
            assert index.cell_most[c] == index.weight[places].max() and {e // toxicity.BLOCK for e in index.example[places]} == {index.cell_block[c]}
            held[index.example[places], t] = index.weight[places]
    return held


def plain_score(index, held, text):
    """The score from all cosines; None if it hangs on a tie that sums in another order may break differently."""
    q = np.zeros(held.shape[1])
    for word in set(toxicity.tokens(text)) & set(index.ids):
        q[index.ids[word]] = (1 + math.log(toxicity.tokens(text).count(word))) * index.idf[index.ids[word]]
    if not q.any():
        return index.empty
    cos = held @ (q / np.linalg.norm(q))
    order = np.argsort(-cos, kind="stable")
    order = order[cos[order] > 1e-12]
    if len(order) > toxicity.K and cos[order[toxicity.K - 1]] - cos[order[toxicity.K]] < 1e-9:
        return None
    near = [(min(float(cos[e]), 1.0), int(e)) for e in order[: toxicity.K]]
    return min(max(index.probability(index.vote(near)), 0.0), 1.0) if near else index.empty


def test_columns_are_not_copied():
    rng = random.Random(5)
    terms = {f"t{i:03}": 1.0 for i in range(200)}
    examples = [({t: rng.random() for t in rng.sample(range(200), 150)}, e % 2, e) for e in range(1280)]
    index = toxicity.Index(terms, [({t: w / math.hypot(*v.values()) for t, w in v.items()}, y, e) for v, y, e in examples], {0: 1.0, 1: 1.0}, 0.0)
    text = " ".join(f"t{i:03}" for i in range(0, 200, 3))
    want = index.nearest(index.vector(text))
    index.read = 0
    tracemalloc.start()
    got = index.score(text)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want and index.read > index.blocks // 2 and peak < index.columns.nbytes / 4
    cos = dense(index) @ np.array([float(f"t{i:03}" in text) for i in range(200)])
    assert [e for _, e in got] == np.argsort(-cos, kind="stable")[: toxicity.K].tolist()


def test_nearest_is_exact(fitted):
    texts, _, _, index = fitted
    held = dense(index)
    for text in [*texts[:80], "zonkwort qrumple zonkoid zonkoid", ""]:
        want = plain_score(index, held, text)
        assert want is None or math.isclose(index.score(text)[0], want, abs_tol=1e-9)


def test_blocks_are_left_unread(spark):
    """Blocks of examples about something else fall to the bounds."""
    rng = random.Random(5)
    topics = [[f"{t:02d}w{j:02d}" for j in range(30)] for t in range(24)]
    examples = [({30 * t + j: 1 / math.sqrt(8) for j in rng.sample(range(30), 8)}, int(t % 2), 100 * t + i) for t in range(24) for i in range(toxicity.BLOCK)]
    index = toxicity.Index({w: 1.0 for t in topics for w in t}, examples, {0: 1.0, 1: 1.0}, 0.0)
    for t, i in ((0, 3), (7, 50), (23, 0)):
        vector = dict(examples[t * toxicity.BLOCK + i][0]) | {(30 * t + 100) % 720: 0.05}
        before = index.read
        got = index.nearest(vector)
        assert len(got) == toxicity.K and {e // toxicity.BLOCK for _, e in got} == {t}
        assert index.read - before <= toxicity.FIRST_BLOCKS < index.blocks


def test_scores(fitted, spark):
    texts, labels, df, index = fitted
    rows = toxicity.score(df, index).orderBy("doc_id").collect()
    assert sum((r.score >= 0.3) == bool(y) for r, (_, y) in zip(rows, labels)) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert any(r.evidence for r in rows)
    assert toxicity.score(df, index).columns == [*df.columns, "score", "evidence"]


@pytest.mark.skipif(not os.path.exists(LARGER), reason="the larger tables are not here")
def test_held_out(spark):
    got = op7_toxicity(spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("toxic is not null")
    found = {(r.predicted, r.toxic): r["count"] for r in got.groupBy("predicted", "toxic").count().collect()}
    assert found[1, 1] >= 0.9 * (found[1, 1] + found.get((0, 1), 0))
    assert found.get((1, 0), 0) <= 0.03 * found[0, 0]


def test_query_against_all_cosines(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    index = toxicity.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out))
    assert set(index.toxic) == {0, 1}
    vectors, compared, alone = dense(index), 0, 0
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in op7_toxicity(spark, sf_dir).collect():
        want = plain_score(index, vectors, texts[r.doc_id])
        alone += not index.score(texts[r.doc_id])[1]
        if want is not None:
            compared += 1
            assert math.isclose(r.score, want, abs_tol=1e-9)
    assert compared > 0.8 * len(texts) and alone < 0.2 * len(texts)


def test_query(spark, sf_dir):
    got = op7_toxicity(spark, sf_dir)
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert {(r.score >= 0.3) == bool(r.predicted) for r in rows} == {True}


def test_edges(fitted, spark):
    _, _, _, index = fitted
    df = edge_docs(spark)
    rows = toxicity.score(df, index).collect()
    assert len(rows) == df.count() and all(r.score == index.empty for r in rows if not (r.text or "").strip())
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.fit(df, none) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), index).count() == 0
    elsewhere = spark.createDataFrame([(10**9, 1)], "doc_id long, toxic int")
    assert toxicity.fit(df, elsewhere) is None
    one = toxicity.fit(docs(spark, ["only one class here"] * 6), spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, toxic int"))
    assert toxicity.score(df, one).where(F.col("score").isNull()).count() == 0
