import re
from fractions import Fraction

from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, brute, docs, edge_docs

from docengine.llm import mixing
from docengine.llm.queries import op2_mix


def targets(sizes):
    """Sharing in rounds, as the rule is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    full: set = set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        share = {s: Fraction(3 * sizes[s]) if s in full else Fraction(left * weight[s], free) for s in names}
        above = {s for s in names if s not in full and share[s] >= 3 * sizes[s]}
        if not above:
            return share
        full |= above


def test_targets(spark):
    for texts, sources in (
        (["a b c", "d", "e f", "", None, "g"], ["x", "y", "x", "z", "w", None]),
        (["w " * 100, "w " * 3, "w " * 5, "w", "w w"], ["b", "a", "é", "zz", None]),
        (["", None], ["a", "b"]),
    ):
        df = docs(spark, texts, sources)
        sizes = {}
        for t, s in zip(texts, sources):
            sizes[s] = sizes.get(s, 0) + len((t or "").split())
        want = targets(sizes) if sum(sizes.values()) else {s: 0 for s in sizes}
        for r in mixing.plan(df).collect():
            assert abs(r.target - float(want[r.source])) < 1e-9
            assert r.source_size == sizes[r.source] and 0 <= r.copies <= 3


def test_query(spark, sf_dir):
    rows = op2_mix(spark, sf_dir).collect()
    texts = dict(brute(spark, sf_dir))
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) for r in rows)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) / sum(r.size for r in rows) - 1) < 0.25
    assert sorted(rows) == sorted(op2_mix(spark, sf_dir).collect())


def test_near_target(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 + 1 as int)) as text", "'en' as lang", "concat('s', id % 3) as source", "0L as n_chars")
    for r in mixing.plan(df).groupBy("source").agg({"target": "max", "copies": "count"}).collect():
        pass
    for r in mixing.plan(df).selectExpr("source", "target", "copies * size as taken").groupBy("source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.06


def test_mix_and_edges(spark):
    df = edge_docs(spark)
    planned = mixing.plan(df, keep=["doc_id", "text"]).collect()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in planned)
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.plan(spark.createDataFrame([], DOCS)).count() == 0


def test_long_table_of_rates(spark, monkeypatch):
    df = docs(spark, ["a b c", "d", "e f", None, "g"], ["x", "y", None, "w", None])
    want = sorted((r.doc_id, r.copies) for r in mixing.plan(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted((r.doc_id, r.copies) for r in mixing.plan(df).collect()) == want


def test_names_that_clash(spark):
    df = docs(spark, ["a b c"] * 6).withColumnsRenamed({"lang": "mix_rate", "n_chars": "copy"}).withColumns({c: F.lit(1) for c in ("_source", "_mix_size", "_copy", "mix_size", "salt", "of_source")})
    out = mixing.mix(df)
    assert out.columns == df.columns and {r.copy for r in out.collect()} == {5}
    assert mixing.plan(df).columns == [*df.columns, "size", "source_size", "target", "rate", "copies"]


def test_numbers_of_many_sources(spark):
    names = [None, "é", "z", "Z", *(f"host{i}.org" for i in range(400))]
    per = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(7)
    got = {r.source: r.number for r in mixing._numbered(per).collect()}
    assert got == {n: i for i, n in enumerate([*sorted(names[1:], key=lambda x: x.encode()), None])}
