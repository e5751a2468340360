import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import brute, docs, edge_docs

from docengine.llm import line_dedup
from docengine.llm.queries import op10_line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]")


def distance(a, b, enough=1 << 30):
    """The edit distance; some number above enough if it is above that."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > enough:
            return min(row)
    return row[-1]


def allowed(length):
    return next(t for below, t in line_dedup.EDITS if length < below)


def plain(rows, threshold=None):
    """(n_lines, n_exact, n_near, text) by row, from all pairs of texts."""
    first = {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                first[line] = min(first.get(line, 1 << 63), key)
    order = sorted(first, key=lambda x: (first[x], x.encode()))
    kept, near = {}, set()
    for x in order:
        by = [y for n in range(len(x) - 3, len(x) + 4) for y in kept.get(n, ())]
        edits = lambda y: allowed(min(len(x), len(y))) if threshold is None else threshold
        if any(abs(len(x) - len(y)) <= edits(y) and edits(y) and distance(x, y, edits(y)) <= edits(y) for y in by):
            near.add(x)
        else:
            kept.setdefault(len(x), []).append(x)
    out = []
    for key, text in rows:
        kept, seen, n, exact, close = [], set(), 0, 0, 0
        for line in (text or "").split("\n"):
            if not WORD.search(line):
                kept.append(line)
                continue
            n += 1
            if line in near:
                close += 1
            elif first[line] != key or line in seen:
                exact += 1
            else:
                kept.append(line)
            seen.add(line)
        out.append((n, exact, close, None if text is None else "\n".join(kept)))
    return out


def corpus(rng, n):
    base = ["".join(rng.choices("abcdefgh é", k=rng.randrange(3, 60))) for _ in range(40)]

    def line():
        x = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(x) + 1)
            x = rng.choice([x[:i] + "z" + x[i:], x[:i] + x[i + 1 :], x[:i] + "y" + x[i + 1 :]])
        return rng.choice([x, x, x, "", "  "]) if rng.random() < 0.1 else x

    return ["\n".join(line() for _ in range(rng.randrange(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_against_all_pairs(spark, threshold):
    texts = corpus(random.Random(threshold), 120)
    got = line_dedup.dedup(docs(spark, texts), threshold=threshold).orderBy("doc_id").collect()
    want = plain(list(enumerate(texts)), threshold)
    assert [(r.line_dedup.n_lines, r.line_dedup.n_exact, r.line_dedup.n_near, r.text) for r in got] == want
    assert sum(w[2] for w in want) > 20


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    rng = random.Random(9)
    pairs = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("é日", "日é"), ("x" * 300, "x" * 299 + "y")]
    for _ in range(600):
        a = "".join(rng.choices("abé", k=rng.randrange(0, 14)))
        b = a
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b[:i] + "c" + b[i:], b[:i] + b[i + 1 :], b[:i] + "a" + b[i + 1 :]])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("got")).collect():
        assert r.got == (distance(r.a, r.b) <= threshold), (r.a, r.b)


def test_query(spark, sf_dir):
    rows = brute(spark, sf_dir)
    got = {r.doc_id: tuple(r)[1:] for r in op10_line_dedup(spark, sf_dir).collect()}
    for (key, _), (n, exact, near, text) in zip(rows, plain(rows)):
        assert got[key] == (n, exact, near, hashlib.sha256((text or "").encode()).hexdigest())


def test_many_needed_texts(spark, monkeypatch):
    texts = corpus(random.Random(8), 60)
    want = [r.text for r in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()]
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
    assert [r.text for r in line_dedup.dedup(docs(spark, texts)).orderBy("doc_id").collect()] == want


def test_edges(spark):
    df = edge_docs(spark)
    out = line_dedup.dedup(df)
    assert out.columns == [*df.columns, "line_dedup"]
    rows = out.collect()
    assert len(rows) == df.count()
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.text for r in rows if r.doc_id == 5] == ["same row"] * 2
    assert [r.text for r in rows if r.doc_id == 3] == ["word " * 30_000]
    assert line_dedup.dedup(docs(spark, [])).count() == 0
    assert line_dedup.dedup(df.withColumnRenamed("size", "line_dedup")).columns.count("line_dedup") == 1
    clash = df.withColumnRenamed("size", "h1").withColumnRenamed("n_chars", "doc").withColumnRenamed("lang", "gone")
    assert sorted(r.text or "" for r in line_dedup.dedup(clash).collect()) == sorted(r.text or "" for r in rows)


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"line {i % 9000}" for i in range(18_000))
    got = line_dedup.dedup(docs(spark, [text])).first()
    assert got.text == "\n".join(f"line {i}" for i in range(9000)) and got.line_dedup.n_exact == 9000


def test_parity_rules_out_no_link(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choices("ab  c", k=30))
        i = rng.randrange(30)
        pairs.append((a, rng.choice([a[:i] + " " + a[i:], a[:i] + a[i + 1 :], a[:i] + " " + a[i + 1 :], a[:i] + "z" + a[i + 1 :]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(~line_dedup.close(line_dedup.word_parity(F.col("a")), line_dedup.word_parity(F.col("b")), 1)).count() == 0


def test_letters_rule_out_no_link(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choices("aab cdé日", k=40))
        b = a
        for _ in range(3):
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b[:i] + "a" + b[i:], b[:i] + b[i + 1 :], b[:i] + "😀" + b[i + 1 :], b[:i] + " " + b[i:]])
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    far = F.bit_count(line_dedup.letter_counts(F.col("a")).bitwiseXOR(line_dedup.letter_counts(F.col("b"))))
    assert df.where(far > 6).count() == 0
    assert df.select(F.bit_count(line_dedup.letter_counts(F.lit("xxxxx")).bitwiseXOR(line_dedup.letter_counts(F.lit("yyx")))).alias("n")).first().n == 2  # 5 and 1 alike modulo 4, 0 and 2


@pytest.mark.parametrize("few", [False, True])
def test_crowded_keys(spark, monkeypatch, few):
    """Lines that share long parts, in keys that all have their letters counted."""
    rng = random.Random(21)
    base = ["".join(rng.choices("abcdefgh é", k=90)) for _ in range(4)]
    lines = []
    for _ in range(160):
        x = rng.choice(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(x))
            x = x[:i] + "".join(rng.choices("abcxyz", k=rng.choice([1, 1, 5]))) + x[i + rng.choice([0, 1, 5]) :]
        lines.append(x)
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    if few:
        monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", 0)
    got = line_dedup.dedup(docs(spark, lines)).orderBy("doc_id").collect()
    assert [(r.line_dedup.n_exact, r.line_dedup.n_near, r.text) for r in got] == [w[1:] for w in plain(list(enumerate(lines)))]


def test_several_edits_by_length(spark):
    """Against all pairs, with lines on both sides of every border of EDITS and of classes."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh é", k=k)) for k in [*range(5, 80), 127, 128, 129, 143, 144, 145, 400] for _ in range(2)]
    lines = []
    for x in base:
        for n in (0, 1, 2, 3, 4):
            y = x
            for _ in range(n):
                i = rng.randrange(len(y) + 1)
                y = rng.choice([y[:i] + "z" + y[i:], y[:i] + y[i + 1 :], y[:i] + "y" + y[i + 1 :]])
            lines.append(y)
    lines = list(dict.fromkeys(lines))
    rng.shuffle(lines)
    near = {i for i, w in enumerate(plain(list(enumerate(lines)))) if w[2]}
    got = line_dedup.dedup(docs(spark, lines)).where("line_dedup.n_near > 0").collect()
    assert {r.doc_id for r in got} == near
    assert max(t for _, t in line_dedup.EDITS) > 1 and len(near) > 200


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_short_lines(spark, threshold):
    """Lines of up to a dozen characters go through the same join."""
    rng = random.Random(threshold)
    lines = list(dict.fromkeys("".join(rng.choices("abc", k=rng.randrange(1, 13))) for _ in range(300)))
    got = line_dedup.dedup(docs(spark, lines), threshold=threshold).orderBy("doc_id").collect()
    assert [(r.line_dedup.n_near, r.text) for r in got] == [(w[2], w[3]) for w in plain(list(enumerate(lines)), threshold)]


def test_what_goes_is_near_to_what_stays(spark):
    lines = ["section 1 of the agreement a", "section 2 of the agreement a", "section 2 of the agreement b", "section 3 of the agreement b", "section 3 of the agreement c"]
    got = line_dedup.dedup(docs(spark, lines), threshold=1).orderBy("doc_id").collect()
    assert [r.text for r in got] == [lines[0], "", lines[2], "", lines[4]]


def test_names_that_clash(spark):
    df = docs(spark, ["one line", "one line"]).withColumnsRenamed({"lang": "doc_", "source": "_ld_doc", "n_chars": "hash"})
    out = line_dedup.dedup(df.withColumn("Gone", F.lit(1)).withColumn("least", F.lit(2)))
    assert sorted(r.text for r in out.collect()) == ["", "one line"]


def test_texts_are_split_once(spark):
    lines = line_dedup._lines(docs(spark, ["a b\nc", None, "", "\n"]), "doc_id", "text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "size(split(" not in plan(lines) and sorted(r.line for r in lines.collect()) == ["a b", "c"]
    # keys beside the lambda of the words' parity: a projection that is compiled in parts
    keys = next(x for x in plan(line_dedup._texts(lines, None)).split("+- ") if "xxhash64(0, least" in x)
    assert "aggregate(split(" in keys
