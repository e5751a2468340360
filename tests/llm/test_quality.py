import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import brute, docs, edge_docs

from docengine.llm import quality
from docengine.llm.queries import op6_quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)


def measured(text):
    import zstandard

    return quality.measure(text, zstandard.ZstdCompressor(level=3).compress)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é", "\n", " ", "\x0b", "\x85", "#", "|x", " "]), max_size=400).map(" ".join))
def test_base_rules(text):
    assert measured(text)[:6] == plain(text)


def test_long_windows():
    text = " ".join(str(i % 700) for i in range(1500))
    assert measured(text)[:6] == plain(text)


def test_query(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in op6_quality(spark, sf_dir).collect()}
    rows = brute(spark, sf_dir)
    assert len(got) == len(rows)
    for key, text in rows:
        assert got[key][:6] == plain(text)
        assert not (got[key][5] and got[key][6])


def test_bands(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for _ in range(200))
    letters = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    mixed = " ".join(letters[i : i + 3] for i in range(0, 4000, 3))
    varied = [f"w{i} and {rng.choice(['red', 'blue', 'green'])} {rng.randrange(10**6)}" for i in range(60)]
    repeated = " ".join(" ".join(f"{a}{b}" for a in "abcdefgh" for b in "ijklmnop") + f" {i}." for i in range(40))
    got = [r.kept for r in quality.assess(docs(spark, [noise, mixed, " ".join(varied), repeated])).orderBy("doc_id").collect()]
    assert got[2] and not got[3]


def test_labelled_good_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    kept = op6_quality(spark, sf_dir).join(labels, "doc_id")
    assert kept.where("not kept and not base_failed").count() == 0


def test_edges(spark):
    df = edge_docs(spark)
    rows = quality.assess(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)
    assert not any(r.kept for r in rows if not r.text)
    assert quality.assess(docs(spark, [])).count() == 0
    assert quality.assess(df.withColumnRenamed("size", "kept")).columns.count("kept") == 1


@pytest.mark.parametrize("n", [3, 4, 80, 81, 200])
def test_both_ways_of_counting(n):
    text = " ".join("ab cd ef gh ij".split()[i * i % 5] for i in range(n))
    assert measured(text)[:6] == plain(text)


def test_bands_reject_noise_and_soft_repeats(spark):
    import random

    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for _ in range(200))
    letters = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    mixed = " ".join(letters[i : i + 3] for i in range(0, 4000, 3))
    lower = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 11))) for _ in range(1000))
    few = " ".join("".join(rng.choices([chr(c) for c in range(33, 127)], k=rng.randrange(3, 11))) for _ in range(60))
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(150)]
    dull = " ".join(rng.choices(vocabulary, k=1500))
    rows = quality.assess(docs(spark, [noise, mixed, lower, few, dull])).collect()
    assert not any(r.base_failed or r.kept for r in rows)


def test_bands_alone_reject_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality(spark, sf_dir).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in rows}
    assert count[0, False] > 0 and (1, False) not in count
