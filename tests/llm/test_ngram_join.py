import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import brute, docs, edge_docs

from docengine.llm import ngram_join
from docengine.llm.queries import op8_ngram_join


def shingle_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < 5 else zip(*(ws[i:] for i in range(5))))


def plain(rows):
    """(size, smallest id reachable) by id, from all pairs."""
    sets = {k: shingle_set(t) for k, t in rows}
    label, index = {k: k for k in sets}, {}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in sorted(sets):
        counts = {}
        for s in sets[k]:
            for other in index.setdefault(s, []):
                counts[other] = counts.get(other, 0) + 1
            index[s].append(k)
        for other, n in counts.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                label[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def corpus(rng, n, vocab=400):
    passage = [f"p{i}" for i in range(24)]
    seeds = [[f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    texts = []
    for _ in range(n):
        ws = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(2000)}"
        if rng.random() < 0.3:
            ws = ws + passage
        if rng.random() < 0.1:
            ws = passage + [f"y{rng.randrange(5)}"]
        texts.append(rng.choice(["", " ", "\n"]).join([" ".join(ws), ""]))
    return texts


def same(spark, texts, **options):
    got = {r.doc: (r["size"], r.component) for r in ngram_join.classes(docs(spark, texts, start=10), **options).collect()}
    want = plain([(10 + i, t) for i, t in enumerate(texts)])
    assert got == want


@pytest.mark.parametrize("all_pairs", [1, 3, 48])
def test_against_all_pairs(spark, all_pairs):
    same(spark, corpus(random.Random(all_pairs), 250), all_pairs=all_pairs)


def test_larger_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        ws = list(base)
        for _ in range(rng.randrange(0, 5)):
            ws[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(ws))
    same(spark, texts)
    same(spark, texts, all_pairs=8)
    same(spark, texts, all_pairs=8, split=40)


def test_frequent_shingles_are_dealt_out(spark):
    rng = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} {' '.join(f'q{rng.randrange(40)}' for _ in range(rng.randrange(0, 9)))}" for _ in range(200)]
    same(spark, texts, all_pairs=4, split=30)
    same(spark, texts, all_pairs=4, split=1)


def test_chain(spark):
    words = [f"w{i}" for i in range(400)]
    same(spark, [" ".join(words[i : i + 100]) for i in range(0, 300, 6)] + ["a b", "A B", "a", "", None, "b a"])


def test_query(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_join(spark, sf_dir).collect()}
    assert got == plain(brute(spark, sf_dir))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(1, 400), st.integers(0, 400))
def test_prefixes_are_long_enough(a, b, shared):
    a, b = min(a, b), max(a, b)
    shared = min(shared, a)
    if 100 * shared >= 75 * (a + b - shared):
        assert shared >= ngram_join.needed(a, b)
        assert a - shared + 1 <= ngram_join.prefix(a) and b - shared + 1 <= ngram_join.prefix(b)
    else:
        assert shared < ngram_join.needed(a, b)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_counts_of_prefixes_rule_out_no_link(x, y):
    both = len(x & y)
    if 100 * both >= 75 * len(x | y):
        p, q = sorted(x)[: ngram_join.prefix(len(x))], sorted(y)[: ngram_join.prefix(len(y))]
        pair = np.zeros(1, ngram_join.PAIR)
        pair["size_a"], pair["size_b"] = len(x), len(y)
        assert ngram_join.possible(pair, np.array([len(set(p) & set(q))])).all()


def test_shingles():
    assert len(ngram_join.shingles("a b c d e f")) == 2
    assert len(ngram_join.shingles("a b c d e a b c d e")) == len(shingle_set("a b c d e a b c d e"))
    assert len(ngram_join.shingles("a b")) == 1 and len(ngram_join.shingles(" \n")) == 0 == len(ngram_join.shingles(None))
    assert np.array_equal(ngram_join.shingles("A\tB\x0bC"), ngram_join.shingles("a b c"))
    assert not np.array_equal(ngram_join.shingles("a\x85b"), ngram_join.shingles("a b"))
    assert not np.array_equal(ngram_join.shingles("É"), ngram_join.shingles("é"))


def test_edges(spark):
    df = edge_docs(spark)
    out = ngram_join.join(df)
    assert out.columns == [*df.columns, "ngram_join"]
    rows = out.collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r.ngram_join for r in rows}
    assert (by[1].n_shingles, by[1].component) == (0, 1) and (by[2].n_shingles, by[2].component) == (0, 2)
    assert (by[5].n_shingles, by[5].component) == (1, 5) and by[3].n_shingles == 1 and by[None].component is None
    assert ngram_join.join(docs(spark, [])).count() == 0
    clash = df.withColumnRenamed("size", "node").withColumnRenamed("n_chars", "component").withColumnRenamed("lang", "ngram_join")
    assert ngram_join.join(clash).count() == len(rows)
    ids = spark.createDataFrame([(None, "one two three four five six"), (9, "one two three four five six"), (7, "one two three four five six")], "doc_id long, text string")
    assert {r.ngram_join.component for r in ngram_join.join(ids).collect()} == {7}


def test_shuffled_verification(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ngram_join, "CELL_BYTES", 400)
    monkeypatch.setattr(ngram_join, "RANGES", 3)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 500)
    same(spark, corpus(random.Random(5), 120))


def test_small_tables_take_few_files(spark, monkeypatch):
    made, own = [], ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda *a: made.append(own(*a)) or made[-1])
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        texts = corpus(random.Random(8), 300)
        found = ngram_join.classes(docs(spark, texts, start=0))
        got = {r.doc: (r.size, r.component) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(enumerate(texts))
    most = ngram_join.FILES * spark.sparkContext.defaultParallelism
    assert max(len(df.inputFiles()) for df in made) <= most < 40 and found.rdd.getNumPartitions() <= most


def test_names_that_clash(spark):
    df = docs(spark, ["one two three four five six"] * 2).withColumnsRenamed({"lang": "_nj_key", "source": "doc", "n_chars": "Hash"})
    out = ngram_join.join(df)
    assert out.columns == [*df.columns, "ngram_join"] and {r.ngram_join.component for r in out.collect()} == {0}


def test_pairs_are_summed_in_bounded_parts(spark, monkeypatch):
    """Their number follows the texts, not the entries: half of these texts share a line with each other and nothing else."""
    for name, value in {"UNIT_PAIRS": 300, "HELD_PAIRS": 200, "STEP_PAIRS": 100, "ROW_PAIRS": 50, "HEAVY": 0, "PACKED": 1000}.items():
        monkeypatch.setattr(ngram_join, name, value)
    dealt, own = [], ngram_join._units
    monkeypatch.setattr(ngram_join, "_units", lambda packed: dealt.append(own(packed)) or dealt[-1])
    rng = random.Random(12)
    shared = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) for _ in range(3)]
    texts = [f"{shared[i % 3]} {' '.join(rng.choice('klmnopqrst') * 2 for _ in range(30))}" for i in range(100)] + corpus(rng, 100)
    same(spark, texts)
    units = {}
    for r in dealt[0].collect():
        units[r.unit] = units.get(r.unit, 0) + len(r.pairs) // ngram_join.PAIR.itemsize
    assert sum(units.values()) > 4 * 300 and max(units.values()) < 2 * 300


def test_parts_of_meetings(monkeypatch):
    """A fragment gives its pairs in parts, none of them much larger than what is held; together they are all pairs."""
    n, entries = 60, []
    for h in range(20):
        part = np.zeros(n, ngram_join.ENTRY)
        part["hash"], part["node"], part["size"] = h, np.arange(n) + n * h, 40
        entries.append(part)
    parts = list(ngram_join._met(np.concatenate(entries), 64, False))
    assert sum(len(pairs) for pairs, _ in parts) == 20 * n * (n - 1) // 2 and not any(len(kept) for _, kept in parts)
    monkeypatch.setattr(ngram_join, "HELD_PAIRS", 4000)
    monkeypatch.setattr(ngram_join, "STEP_PAIRS", 2000)
    few = list(ngram_join._met(np.concatenate(entries), 64, False))
    assert len(few) > 4 and max(len(pairs) for pairs, _ in few) <= 4000 + 2 * 2000
    assert np.array_equal(np.unique(np.concatenate([p for p, _ in few])), np.unique(np.concatenate([p for p, _ in parts])))


def test_shingles_of_few_in_each_part_are_last(spark):
    """Two of a part are enough; what is in many parts is frequent however small its share of each."""
    texts = ["one two three four five six", "seven eight one two three four five", "nine ten eleven twelve thirteen"]
    rows = ngram_join._described(docs(spark, texts).coalesce(1).selectExpr("doc_id doc", "doc_id same", "text")).where("hash is not null").collect()
    (shared,) = set(ngram_join.shingles(texts[0]).tolist()) & set(ngram_join.shingles(texts[1]).tolist())
    assert [(r["hash"] % 2**64, r["count"]) for r in rows] == [(shared, 2)]
