import random
import re

import numpy as np
from tests.llm.helpers import brute, docs, edge_docs

from docengine.llm import licenses
from docengine.llm.queries import op9_licenses

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    ws = fold(text)
    places = [(i, label) for phrase, label in PHRASES for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(rows, texts):
    got = {r.doc_id: r for r in rows}
    for key, text in texts:
        r = got[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_query(spark, sf_dir):
    check(op9_licenses(spark, sf_dir).collect(), brute(spark, sf_dir))


def test_random_texts(spark):
    rng = random.Random(1)
    parts = ["CC", "BY", "cc", "by", "-", " ", "é", "General", "Public", "License", "license", "All", "rights", "reserved", ".", "\n", "the", "of", "MIT", "日本", "\x7f"]
    texts = ["".join(x + rng.choice([" ", " ", "-", ""]) for x in rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(500)]
    check(licenses.summary(licenses.scan(docs(spark, texts))).collect(), list(enumerate(texts)))


def test_matching_statistics():
    """The automaton's runs against all runs that the templates have."""
    rng = random.Random(2)
    templates = [[rng.randrange(1, 5) for _ in range(rng.randrange(3, 14))] for _ in range(8)] + [[1, 1, 1, 1, 1]]
    automaton = licenses.Automaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(300):
        text = [rng.randrange(1, 6) for _ in range(30)]
        longest = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(text))]
        want = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= licenses.MIN_MATCH and (i + 1 == len(text) or longest[i + 1] != n + 1)]
        got = list(automaton.matches(text))
        assert [(a, b) for a, b, _ in got] == want
        for a, b, state in got:
            assert sorted(automaton.ends[state]) == sorted((t, e) for t, x in enumerate(templates) for e in range(len(x) + 1) if e >= b - a and x[e - (b - a) : e] == text[a:b])


def test_templates_are_found():
    scanner = licenses.Scanner()
    for label, text in licenses.templates():
        _, _, spans = scanner.scan("some words before " + text + " and after")
        assert any(s[0] == label and s[3] > 0.99 for s in spans), text[:99]
    filled = licenses.TEMPLATES[2][1].replace("copyright notice", "copyright notice 2019 Some Name Here")
    assert any(s[0] == "mit" and s[3] > 0.9 for s in scanner.scan(filled)[2])
    assert scanner.scan("the terms of the work are in the file to be read")[2] == []


def test_plain_documents_have_no_labels(spark, sf_dir):
    rows = op9_licenses(spark, sf_dir).collect()
    texts = dict(brute(spark, sf_dir))
    for r in rows:
        if not re.search("licen|reserved|copyright|cc by", (texts[r.doc_id] or "").lower()):
            assert r.labels == "" and r.score == 0


def test_edges(spark):
    df = edge_docs(spark)
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "n_words", "license_base", "license_spans"] and out.count() == df.count()
    check([r for r in licenses.summary(out).collect() if r.doc_id is not None], [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    assert licenses.scan(docs(spark, [])).count() == 0
    assert licenses.scan(df.withColumnRenamed("size", "n_words")).columns.count("n_words") == 1
    assert licenses.Scanner().spans(np.zeros(0, np.int32)) == []


def plain_spans(scanner, ids):
    """All chains by dynamic programming over all places of all longest runs, and the same choice among them."""
    ends = scanner.automaton.ends
    found = []
    known = [i for i, x in enumerate(ids) if x]
    stretches, at = [], None
    for i in known:
        if at is None or i != at[1] + 1:
            at = [i, i]
            stretches.append(at)
        at[1] = i
    runs = [m for a, b in stretches if b - a + 1 >= licenses.MIN_MATCH for m in scanner.automaton.matches(ids[a : b + 1], a)]
    for t, size in enumerate(scanner.sizes):
        nodes = []  # (start, end, stop, covered)
        for start, end, state in runs:
            new = []
            for stop in [s for u, s in ends[state] if u == t]:
                begin = stop - (end - start)
                options = [(c[3] + stop - max(begin, c[2]), -c[0]) for c in nodes if start - c[1] <= licenses.GAP and stop > c[2] and begin - c[2] <= licenses.GAP]
                covered, first = max([*options, (end - start, -start)])
                new.append((-first, end, stop, covered))
            nodes += new
        need = (licenses.NAMED if size < licenses.SHORT else licenses.COVERED) * size
        found += [(t, c[0], c[1], c[3]) for c in nodes if c[3] >= need]
    return max((c[3] / scanner.sizes[c[0]] for c in found), default=0.0), {scanner.labels[c[0]] for c in found}


def test_mutated_templates_keep_their_label():
    """Words are replaced so that runs of three words or more cover three quarters of the template."""
    rng, scanner = random.Random(4), licenses.Scanner()
    lost, tried = [], 0
    for label, text in licenses.templates():
        ws = fold(text)
        if len(ws) < licenses.SHORT:
            continue
        for _ in range(40 if len(ws) < 1000 else 4):
            changed, i = list(ws), rng.randrange(4, 30)
            while i < len(ws):
                if ws[i] not in ("affero", "lesser"):  # without it, the notice is as near to another licence's
                    changed[i] = rng.choice(["zzz", "the", "license", changed[i - 1]])
                i += rng.randrange(12, 30)
            tried += 1
            if label not in {s[0] for s in scanner.scan(" ".join(changed))[2]}:
                lost.append((label, " ".join(changed)[:80]))
    assert tried > 500 and not lost, (len(lost), lost[:3])


def test_best_chain_against_all_chains():
    rng = random.Random(9)
    given = [(f"l{i}", " ".join(rng.choices("abcdefg", k=rng.randrange(20, 60)))) for i in range(4)]
    scanner = licenses.Scanner(given)
    for _ in range(200):
        _, text = rng.choice(given)
        ws = [w if rng.random() > 0.08 else rng.choice("abcxyz") for w in text.split()]
        ids = [scanner.vocab.get(w.encode(), 0) for w in ["x"] * 3 + ws + ["y"] * 3]
        best, labels = plain_spans(scanner, ids)
        got = scanner.spans(np.array(ids, np.int32))
        assert {s[0] for s in got} <= labels and bool(got) == bool(labels)
        assert all(s[3] <= best + 1e-9 for s in got)


def test_names_tell_licences_apart():
    scanner = licenses.Scanner()
    labels = lambda text: {s[0] for s in scanner.scan(text)[2]}
    assert labels("This project is licensed under the terms of the Apache license.") == set()
    assert labels("This project is licensed under the terms of the MIT license.") == {"mit"}
    assert labels("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.") == set()
    assert labels(dict((label, text) for label, text in licenses.TEMPLATES)["lgpl"]) == {"lgpl"}
