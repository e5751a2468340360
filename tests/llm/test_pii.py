import hashlib
import random
import re

from pyspark.sql import functions as F
from tests.llm.helpers import brute, docs, edge_docs

from docengine.llm import pii
from docengine.llm.queries import op4_pii


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    text = text or ""
    spans = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            spans.append((2, m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((3, m.start(), m.end(), "phone"))
    return sorted(spans)


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for _, a, b, k in spans)


def check(rows, texts):
    got = {r.doc_id: r for r in rows}
    for key, text in texts:
        want = base(text)
        assert got[key].base_sha256 == hashlib.sha256(line(want).encode()).hexdigest(), (text, line(want))
        assert set(filter(None, line(want).split(","))) <= set(got[key].spans.split(","))
        assert (got[key].n_email, got[key].n_ip, got[key].n_card, got[key].n_phone) == tuple(sum(s[0] == k for s in want) for k in range(4))


def test_query(spark, sf_dir):
    check(op4_pii(spark, sf_dir).collect(), brute(spark, sf_dir))


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "x-1", "%", "+", "é", " ", "-", "1", "12", "255", "256", "007", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "(", ")", "1.2.3.4", "日", "\n", "49", "0000000255"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 30))) for _ in range(1500)]
    check(pii.summary(pii.scan(docs(spark, texts))).collect(), list(enumerate(texts)))


def test_runs_are_read_once(spark):
    texts = ["a" * 10_000, "1" * 10_000, "a@" + "b." * 5_000, "1." * 4_000, "+1" + " " * 50_000, "1 " * 50_000]
    check(pii.summary(pii.scan(docs(spark, texts))).collect(), list(enumerate(texts)))


def test_added_spans(spark):
    texts = [f"please call me by phone 555-{100 + i}-{2000 + i} or mail joe{i} (at) corp{i} (dot) com" for i in range(60)]
    texts += [f"isbn serial 000-{100 + i}-{1000 + i} in release 1.2.3.4/9" for i in range(60)]
    rows = pii.summary(pii.scan(docs(spark, texts))).orderBy("doc_id").collect()
    assert all("phone:" in r.spans and "email:" in r.spans for r in rows[:60])
    assert not any("phone:" in r.spans for r in rows[60:])


def test_em_finds_the_reliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple((1 if y else -1) if rng.random() < p else (-1 if y else 1) for p in (0.95, 0.8, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    prior, table, post = pii._em(sorted(counts.items()))
    assert abs(prior - 0.4) < 0.08
    assert table[0][1][1] > table[1][1][1] > table[2][1][1]
    assert post[1, 1, 1] > 0.95 and post[-1, -1, -1] < 0.05


def test_edges(spark):
    df = edge_docs(spark)
    out = pii.scan(df)
    assert out.columns == [*df.columns, "pii_base", "pii_spans"] and out.count() == df.count()
    assert out.where("text is null").first().pii_spans == []
    assert pii.scan(docs(spark, [])).count() == 0
    assert pii.scan(df.withColumnRenamed("size", "pii_base")).columns.count("pii_base") == 1


def plain_candidates(text):
    """(kind, start, end, strict, known, context, shape) by the module's lists, in plain Python."""
    text, out = text or "", []
    for rank, kind in enumerate(pii.KINDS):
        pattern = pii.WIDE[kind].replace(r"(?:\G|", "(?:")
        at = 0
        while m := re.compile(pattern).search(text, at):
            if kind == "email":  # a match may begin where the one before ended
                follow = re.compile(pii.WIDE[kind].split(")", 2)[2].removeprefix(")")).match(text, at) if at else None
                m = follow or m
            at, last = m.end(), at
            s, digits = m[0], re.sub("[^0-9]", "", m[0])
            fits = re.search(pii.STRICT[kind], s) is not None
            strict = 1 if fits and (kind != "card" or luhn(digits)) else -1
            if kind == "email":
                ending = (re.search("([A-Za-z0-9-]+)$", s) or [""] * 2)[1].lower()
                known = -1 if ending in pii.FILES else int(ending in pii.DOMAINS)
            elif kind == "ip":
                known = -1 if re.search(pii.RESERVED + "|/", s) else 1
            elif kind == "card":
                known = -1 if re.search("^(0000|1234|9999)", s) else int(re.search(pii.ISSUERS, digits) is not None)
            else:
                code = re.match(r"\+?([0-9]{1,3})[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]", s)
                area = re.search(r"([0-9]{3})\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", s)[1]
                lead = re.match(r"^(\+?[0-9]{1,3}[\x20.-]?)?\(?(000|123|999)\)?[\x20.-]", s)
                known = -1 if lead else int((not code and re.match(r"^(\+?[0-9]{1,3}[\x20.-]?)?\(?[2-9]", s) is not None) or (code is not None and code[1] in pii.CALLING) or (not code and area[0] in "23456789"))
            before = text[max(last, m.start() - 33) : m.start()]
            if m.start() - last > 32:
                before = re.sub(r"^[^\W_]+", "", before)
            words = set(re.findall(r"[^\W_]+(?:-[^\W_]+)*|[^\W_]+", before.lower())) | set(re.findall(r"[^\W_]+", before.lower()))
            context = -1 if words & set(pii.CONTEXT_AGAINST[kind]) else int(bool(words & set(pii.CONTEXT[kind])))
            out.append((kind, m.start(), m.end(), strict, known, context, int(bool(re.search(r"[\x20(\[]", s))) + 2 * (len(s) > 20)))
    return out


def plain_spans(texts):
    from collections import Counter
    from math import exp

    found = [plain_candidates(t) for t in texts]
    weights = pii.train([(*k, n) for k, n in Counter((c[0], *c[3:]) for cs in found for c in cs).items()])
    out = []
    for text, cs in zip(texts, found):
        spans = base(text)
        fixed = list(spans)
        for kind, a, b, strict, known, context, shape in cs:
            z = sum(w * x for w, x in zip(weights[kind], pii.features(strict, known, context, shape)))
            if 1 / (1 + exp(-z)) >= pii.THRESHOLD and not any(s[3] == kind and s[1] < b and a < s[2] for s in fixed):
                spans.append((pii.KINDS.index(kind), a, b, kind))
        out.append(line(sorted(spans)))
    return out


def varied(n):
    rng = random.Random(11)
    card = lambda lead, k: next(d for _ in range(999) if luhn(d := lead + "".join(rng.choices("0123456789", k=k - len(lead)))))
    personal, other = [], []
    for i in range(n):
        personal += [
            (f"please call me by phone {rng.randrange(200, 900)}-555-{rng.randrange(1000, 9999)} today", "phone"),
            (f"write to joe{i} (at) corp{i} (dot) com now", "email"),
            (f"the card {card('37', 15)} is mine", "card"),
            (f"pay by card {card('4', 16)} 25 05 then", "card"),
            (f"phone +1 ({rng.randrange(200, 900)}) 555-{rng.randrange(1000, 9999)} 2024 05 17 noon", "phone"),
        ]
        other += [
            (f"isbn serial 000-{rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} of it", "phone"),
            (f"the order 99990{rng.randrange(10**9, 10**10 - 1)} came", "card"),
            (f"in release 1.2.3.{i % 200}/9 of it", "ip"),
        ]
    return personal, other


def test_spans_against_plain_python_and_recall(spark):
    personal, other = varied(40)
    texts = [t for t, _ in personal + other] + ["mail joe@corp.example.com from 10.1.2.3", "basically a hotel 300-555-1234", "", "é 10.0.0.1/8 ip 8.8.8.8"]
    got = [r.spans for r in pii.summary(pii.scan(docs(spark, texts))).orderBy("doc_id").collect()]
    assert got == plain_spans(texts)
    caught = [any(s.startswith(kind) for s in spans.split(",")) for spans, (_, kind) in zip(got, personal)]
    bare = [any(s[3] == kind for s in base(t)) for t, kind in personal]
    assert sum(caught) >= 0.9 * len(personal) and sum(bare) < 0.3 * len(personal)
    wrong = [spans for spans, (t, kind) in zip(got[len(personal) :], other) if kind + ":" in spans and not any(s[3] == kind for s in base(t))]
    assert len(wrong) <= 0.1 * len(other)


def test_context_is_whole_words(spark):
    rows = spark.createDataFrame([("basically",), ("a hotel",), ("call",), ("Tel:",), ("digital",), ("e-mail",)], "w string")
    got = [tuple(r) for r in rows.select(pii._among(pii.CONTEXT["phone"], F.lower("w")), pii._among(pii.CONTEXT_AGAINST["email"], F.lower("w")), pii._among(pii.CONTEXT["email"], F.lower("w"))).collect()]
    assert got == [(False, False, False), (False, False, False), (True, False, False), (True, False, False), (False, False, False), (False, False, True)]


def test_many_matches_take_linear_time(spark):
    import time

    text = "1.2.3.4 x " * 100_000
    frame = docs(spark, [text])
    frame.select(pii.base_spans(F.lit("1.2.3.4"))).collect()
    began = time.perf_counter()
    got = pii.scan(frame).select(F.size("pii_base"), F.size("pii_spans")).first()
    assert tuple(got) == (100_000, 100_000) and time.perf_counter() - began < 40


def test_names_that_clash(spark):
    df = docs(spark, ["call +1 (555) 555-1234"]).withColumnsRenamed({"lang": "pii_candidates", "source": "kind"})
    out = pii.scan(df)
    assert out.columns == ["doc_id", "text", "kind", "n_chars", "pii_base", "pii_spans"] and len(out.first().pii_base) == 1
