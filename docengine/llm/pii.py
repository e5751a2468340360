"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (e-mail addresses, IP addresses, card and phone numbers) give spans of their own. Wider patterns propose
candidates, among them what the base patterns miss: addresses spelled out, numbers that a base match has swallowed with
its neighbours and then dropped, local phone numbers, cards of 13 to 15 digits. Three labelers vote on each candidate (1
personal, 0 abstains, -1 not): a strict regex with check digits, a gazetteer (top-level domains, calling codes, card
issuers, reserved networks) and the words between it and the candidate before. Candidates with the same kind, votes and shape are counted; the table
of counts has at most KINDS * 27 * SHAPES rows whatever the input. On it, expectation-maximisation estimates each
labeler's reliability per kind (probabilities of its three votes for personal and other candidates) and the share of
personal candidates. Its posteriors are the soft labels on which the final span classifier, a logistic regression over
votes and shape, is trained. Candidates with a probability of THRESHOLD or more that do not overlap a base span of their
kind are added; base spans stay.

Null and empty texts have no spans. Texts are taken whole; the places of many matches are summed in blocks. Ties and
repeated rows count as rows. Additional columns travel along, but for columns named pii_base, pii_spans and
pii_candidates, which are replaced. Without candidates, as in an empty table, nothing is trained and nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import SPAN, bind, count_kind, joined_spans, located, materialize, no_spans, regex_spans, running

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values). The bound on the left lets a run be read once; \G lets a match begin where one ended.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Wider candidates: spelled-out addresses, dotted groups, digits alone or grouped, international and local phone numbers.
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{_HOST}++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?{_HOST}++)*+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?:/[0-9]{1,2}+)?+(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}+(?:[\x20.-][0-9]{4}+){3}+|[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}|[0-9]{13,19}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
STRICT = {
    "email": rf"^{_LOCAL}+@{_HOST}[A-Za-z0-9.-]*\.[A-Za-z]{{2,}}$",
    "ip": rf"^{PART}(\.{PART}){{3}}$",
    "card": r"^([0-9]{4}([\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})$",
    "phone": r"^(\+[0-9]{1,3}[\x20.-]?)?(\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
}
#: Gazetteers (fixed values): top-level domains, calling codes, endings of files, first digits of card issuers.
DOMAINS = """ac ae af ai al am app ar at au az ba bd be bg biz bo br by ca cat cc ch cl club cn co com cr cz de dev dk do dz ec edu ee eg es
eu example fi fm fr ge gh gov gr gt hk hn hr hu id ie il in info int invalid io iq ir is it jo jp ke kr kw kz lb li lk lt lu lv ly ma md me
mil mk mn mobi mt mx my name net ng ni nl no np nz online org pa pe ph pk pl pr pro ps pt py qa ro rs ru sa se sg shop si site sk sn sv
sy tech test th tn tr tv tw tz ua ug uk us uy uz ve vn xyz ye za zm zw""".split()
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 373 380 381 385 386 420 421 852 880 886 961 962 966 971 972".split()
FILES = "png jpg jpeg gif svg webp js css py txt md html htm json xml csv log zip gz jar exe dll".split()
ISSUERS = r"^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[68]|6011|64[4-9]|65|35(2[89]|[3-8])|62)"
#: Networks that are nobody's address: this one, loopback, broadcast, multicast.
RESERVED = r"^(0|127|255|22[4-9]|23[0-9])\."
#: Words before a candidate, for and against (fixed values). They count as whole words.
BEFORE = 32
CONTEXT = {
    "email": "mail email e-mail contact write reach address inbox correo courriel mailto kontakt".split(),
    "ip": "ip ipv4 host server address login client from addr adresse dirección".split(),
    "card": "card visa mastercard amex credit debit pay payment account karte carte tarjeta".split(),
    "phone": "phone call tel telephone mobile cell fax contact ring telefon téléphone teléfono handy".split(),
}
CONTEXT_AGAINST = {
    "email": "git version commit ssh scp".split(),
    "ip": "version release section v build chapter".split(),
    "card": "isbn serial order invoice tracking id".split(),
    "phone": "isbn order serial invoice id ref".split(),
}
SHAPES, THRESHOLD, ROUNDS = 4, 0.5, 40

CANDIDATE = "struct<start:int,rank:int,kind:string,end:int,strict:int,known:int,context:int,shape:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(doubled, d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda total, d: total + d) % 10 == 0


def _card(m: Column) -> Column:
    n = F.length(_digits(m))
    return F.when((n >= 16) & (n <= 19), luhn(_digits(m))).otherwise(F.lit(False))


def _phone(m: Column) -> Column:
    n = F.length(_digits(m))
    return (n >= 8) & (n <= 15)


def base_spans(text: Column) -> Column:
    """By kind, then start."""
    kinds = [
        F.when(F.instr(text, "@") > 0, regex_spans(text, EMAIL, 0, "email")).otherwise(no_spans()),
        regex_spans(text, IP, 1, "ip", lambda m: m.rlike(rf"^{PART}(\.{PART}){{3}}$")),
        regex_spans(text, CARD, 2, "card", _card),
        F.when(F.instr(text, "+") > 0, regex_spans(text, PHONE, 3, "phone", _phone)).otherwise(no_spans()),
    ]
    return F.concat(*kinds)


def _vote(pro: Column, con: Column) -> Column:
    return F.when(con, -1).when(pro, 1).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    """The vote of what is known about the candidate's parts."""
    if kind == "email":
        ending = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        return _vote(ending.isin(DOMAINS), ending.isin(FILES))
    if kind == "ip":
        return _vote(~m.rlike(RESERVED), m.rlike(RESERVED + "|/"))
    if kind == "card":
        return _vote(_digits(m).rlike(ISSUERS), m.rlike(r"^(0000|1234|9999)"))
    code = F.regexp_extract(m, r"^\+?([0-9]{1,3})[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]", 1)
    area = r"^(\+?[0-9]{1,3}[\x20.-]?)?\(?"
    return _vote((code == "") & m.rlike(area + "[2-9]") | code.isin(CALLING), m.rlike(area + r"(000|123|999)\)?[\x20.-]"))


def _among(words: list[str], text: Column) -> Column:
    """Whether one of the words stands in the text, with no letter or digit beside it."""
    return text.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])")


def _candidates(text: Column, kind: str) -> Column:
    def emit(m: Column, a: Column, b: Column, piece: Column) -> Column:
        # the words since the candidate before; one character more than is looked at, so that the first one is seen to be whole
        before = F.lower(F.right(piece, F.lit(BEFORE + 1)))
        before = F.when(F.length(piece) > BEFORE, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
        context = bind(before, lambda w: F.when(_among(CONTEXT_AGAINST[kind], w), -1).when(_among(CONTEXT[kind], w), 1).otherwise(0))
        fits = m.rlike(STRICT[kind])
        strict = F.when(fits & luhn(_digits(m)) if kind == "card" else fits, 1).otherwise(-1)
        shape = F.when(m.rlike(r"[\x20(\[]"), 1).otherwise(0) + F.when(F.length(m) > 20, 2).otherwise(0)
        return F.array(F.struct(a.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), b.alias("end"), strict.alias("strict"), _gazetteer(kind, m).alias("known"), context.alias("context"), shape.alias("shape")))

    found = located(text, WIDE[kind], emit, CANDIDATE)
    return F.when(text.contains("@") | text.contains("at)") | text.contains("at]"), found).otherwise(no_spans(CANDIDATE)) if kind == "email" else found


def labelled(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, pii_base (spans) and pii_candidates (spans with votes and shape)."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    wide = F.concat(*(_candidates(whole, k) for k in KINDS))
    return df.select(*(f"`{c}`" for c in keep), base_spans(whole).alias("pii_base"), wide.alias("pii_candidates"))


def _em(rows: list[tuple[tuple[int, int, int], float]]) -> tuple[float, list, dict]:
    """From (votes, count): the share of personal candidates, each labeler's vote probabilities, and posteriors by votes."""
    prior, votes = 0.5, (-1, 0, 1)
    table = [{1: dict(zip(votes, (0.2, 0.3, 0.5))), 0: dict(zip(votes, (0.5, 0.3, 0.2)))} for _ in range(3)]
    post: dict = {}
    for _ in range(ROUNDS):
        post = {}
        for v, _n in rows:
            yes, no = prior, 1 - prior
            for k, x in enumerate(v):
                yes, no = yes * table[k][1][x], no * table[k][0][x]
            post[v] = yes / (yes + no)
        total = sum(n for _, n in rows)
        prior = min(max((sum(n * post[v] for v, n in rows) + 1) / (total + 2), 0.01), 0.99)
        for k in range(3):
            for y in (0, 1):
                part = {x: sum(n * (post[v] if y else 1 - post[v]) for v, n in rows if v[k] == x) + 1.0 for x in votes}
                table[k][y] = {x: part[x] / sum(part.values()) for x in votes}
    return prior, table, post


def _logistic(rows: list[tuple[list[float], float, float]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights from (features, soft label, count), by gradient descent on the mean loss."""
    total, w = sum(n for *_, n in rows), [0.0] * len(rows[0][0])
    for _ in range(steps):
        grad = [ridge * x for x in w]
        for x, y, n in rows:
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - y) * n / total
            for i, xi in enumerate(x):
                grad[i] += err * xi
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def features(strict, known, context, shape) -> list:
    return [1.0, strict, known, context, float(shape % 2), float(shape // 2)]


def train(counts: list[tuple[str, int, int, int, int, int]]) -> dict[str, list[float]]:
    """From (kind, strict, known, context, shape, count): the classifier's weights by kind."""
    weights = {}
    for kind in KINDS:
        own = [r[1:] for r in counts if r[0] == kind]
        if not own:
            continue
        by_vote: dict[tuple, float] = {}
        for a, b, c, _, n in own:
            by_vote[a, b, c] = by_vote.get((a, b, c), 0) + n
        _, _, post = _em(sorted(by_vote.items()))
        weights[kind] = _logistic([(features(a, b, c, s), post[a, b, c], n) for a, b, c, s, n in sorted(own)])
    return weights


def _apart(base: Column, found: Column) -> Column:
    """The spans found that overlap no base span of their kind, in one pass over both in the order of kind and place."""
    at = lambda s, c: s["rank"].cast("long") * (1 << 40) + s[c]
    event = lambda s, own: F.struct(at(s, "start").alias("at"), at(s, "end").alias("to"), F.lit(own).alias("own"), s["kind"].alias("kind"))
    most, none = (1 << 62), F.lit(-1).cast("long")

    def marked(events: Column) -> Column:
        before = running(F.transform(events, lambda e: F.when(e["own"], none).otherwise(e["to"])), F.greatest, none)
        after = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["own"], F.lit(most)).otherwise(e["at"]))), F.least, F.lit(most)))
        both = F.struct(events.alias("events"), before.alias("before"), after.alias("after"))
        return bind(both, lambda b: F.transform(b["events"], lambda e, i: F.when(e["own"] & (F.get(b["before"], i) <= e["at"]) & (F.get(b["after"], i) >= e["to"]), e)))

    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, False)), F.transform(found, lambda s: event(s, True))))
    kept = F.array_compact(bind(events, marked))
    rank = lambda e: (e["at"] / (1 << 40)).cast("int")
    place = lambda e, c: (e[c] % (1 << 40)).cast("int")
    return F.transform(kept, lambda e: F.struct(place(e, "at").alias("start"), rank(e).alias("rank"), e["kind"].alias("kind"), place(e, "to").alias("end")))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and pii_base, pii_spans: arrays of (start, rank, kind, end), by kind, then start."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("pii_base", "pii_spans", "pii_candidates")]
    found = materialize(labelled(df, text, keep))
    groups = found.select(F.explode("pii_candidates").alias("c")).groupBy("c.kind", "c.strict", "c.known", "c.context", "c.shape").count()
    weights = train([tuple(r) for r in groups.collect()])  # at most len(KINDS) * 27 * SHAPES rows

    def score(c: Column) -> Column:
        z = F.lit(-1e9)
        for kind, w in weights.items():
            x = [F.lit(1.0), c["strict"], c["known"], c["context"], c["shape"] % 2, F.floor(c["shape"] / 2)]
            z = F.when(c["kind"] == kind, sum((F.lit(a) * b for a, b in zip(w, x)), F.lit(0.0))).otherwise(z)
        return z

    cut = math.log(THRESHOLD / (1 - THRESHOLD))
    base = F.col("pii_base")
    likely = F.filter("pii_candidates", lambda c: score(c) >= cut)
    apart = bind(likely, lambda cs: F.when(F.size(cs) > 0, _apart(base, cs)).otherwise(no_spans()))
    spans = F.concat(base, apart)
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(f"array<{SPAN}>")
    return found.select(*(f"`{c}`" for c in keep), "pii_base", spans.alias("pii_spans"))


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.col("pii_base")
    counts = [count_kind(base, k).alias(f"n_{k}") for k in KINDS]
    return scanned.select(f"`{key}`", *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("pii_spans")).alias("spans"))
