"""Secret scans, in DataFrame functions only.

Three base patterns give spans of their own. Beyond them, candidate strings (runs of letters, digits and + / _ = -, with
a digit or letters in both cases, of WINDOW characters or more) are measured by the Shannon entropy of every window of
WINDOW characters. One pass slides the window: the counts of the character that leaves and of the one that enters change
by one, and with them the sum of c * log2(c), which is kept in integers so that nothing drifts. The limit depends on the
candidate's character class (hexadecimal or wider). The windows at or above the limit, first to last, are one span of kind
entropy. The allow-list suppresses whole candidates that are words, numbers or identifiers, and the windows that touch a
published example or an alphabet in order.

Null and empty texts have no spans. Texts are taken whole; a candidate of any length is one pass, and the places of many
matches are summed in blocks. Rows stand alone, so ties and repeated rows change nothing; additional columns travel along,
but for columns named secret_base and secret_spans, which are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import any_case, bind, count_kind, free, joined_spans, located, no_spans, regex_spans, span

#: Base patterns (fixed values). Those of one character class are bounded on the left, so that a long run is read once.
NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
ASSIGN = rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, SCALE = 20, 1 << 16
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CLASS = "[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{_CLASS})(?=[A-Za-z+/_=-]*[0-9]|[a-z0-9+/_=-]*[A-Z]{_CLASS}*[a-z]|[A-Z0-9+/_=-]*[a-z]{_CLASS}*[A-Z]){_CLASS}{{{WINDOW},}}"
#: Bits per character from which a window counts.
HEX_BITS, WIDE_BITS = 3.0, 3.7
#: Candidates that are no secrets (fixed values): UUIDs, digits only, words joined by signs with one number, names in camel case with one number, integrity digests.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"^([A-Za-z]?[a-z]+|[A-Z]+)([_/-]+([A-Za-z]?[a-z]+|[A-Z]+))+[_/-]*[0-9]{0,4}$",
    r"^[A-Z]?[a-z]{2,}([A-Z][a-z]{2,})*[0-9]{0,4}$",
    r"^sha(256|384|512)-",
)
#: Parts of candidates that are no secrets (fixed values): alphabets in order, published example keys. Windows that touch one do not count.
ALLOWED_PARTS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP", "EXAMPLEKEY", "IOSFODNN7EXAMPLE")
#: Counts of a window's characters are packed, BITS each, so many to a number.
BITS, PACKED = 5, 12
GROUPS = len(LETTERS) // PACKED + 1


def weights() -> list[int]:
    """c * log2(c) for the counts that a window can have, with one more while it moves, in units of 1 / SCALE."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 2))]


def limit(bits: float) -> int:
    """The entropy is log2(WINDOW) - sum / WINDOW, so bits or more means a sum of at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _entropy_spans(match: Column, start: Column) -> Column:
    f = F.array(*map(F.lit, weights()))
    most = F.when(match.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(limit(HEX_BITS))).otherwise(F.lit(limit(WIDE_BITS)))
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code % PACKED * BITS)

    def count(packed: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(packed, (code / PACKED).cast("int")), code % PACKED * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def moved(packed: Column, code: Column, by: int) -> Column:
        group = (code / PACKED).cast("int")
        return F.transform(packed, lambda n, g: F.when(g == group, n + one(code) * by).otherwise(n))

    def measured(x: Column) -> Column:
        codes, most_ = x["codes"], x["most"]
        none = F.array(*(F.lit(0).cast("long") for _ in range(GROUPS)))

        def enter(acc: Column, i: Column) -> Column:
            """The state with the character at i and without the one that leaves the window; code 0 is a blanked place."""
            into, out = F.get(codes, i), F.get(codes, i - WINDOW)
            came = count(acc["n"], into)
            first = bind(F.struct(moved(acc["n"], into, 1).alias("n"), (acc["sum"] - F.get(f, came) + F.get(f, came + 1)).alias("sum")), lambda a: F.when(out.isNull(), a).otherwise(left(a, out)))
            blank = F.when(into == 0, i).otherwise(acc["blank"])
            return bind(F.struct(first.alias("w"), blank.alias("blank")), lambda s: state(acc, s, i))

        def left(a: Column, out: Column) -> Column:
            gone = count(a["n"], out)
            return F.struct(moved(a["n"], out, -1).alias("n"), (a["sum"] - F.get(f, gone) + F.get(f, gone - 1)).alias("sum"))

        def state(acc: Column, s: Column, i: Column) -> Column:
            begin = i - (WINDOW - 1)
            hit = (begin >= 0) & (s["w"]["sum"] <= most_) & (s["blank"] < begin)
            low = F.when((acc["low"] < 0) & hit, begin).otherwise(acc["low"])
            return F.struct(s["w"]["n"].alias("n"), s["w"]["sum"].alias("sum"), s["blank"].alias("blank"), low.alias("low"), F.when(hit, begin).otherwise(acc["high"]).alias("high"))

        begin = F.struct(none.alias("n"), F.lit(0).alias("sum"), F.lit(-1).alias("blank"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, enter)

    blanked = match
    for part in ALLOWED_PARTS:
        blanked = F.replace(blanked, F.lit(part), F.lit(" " * len(part)))
    codes = F.transform(F.split(blanked, ""), lambda c: F.instr(F.lit(LETTERS), c))
    inner = bind(F.struct(codes.alias("codes"), most.alias("most")), measured)
    spans = bind(inner, lambda r: F.when(r["low"] >= 0, F.array(span(start + r["low"], KINDS.index("entropy"), "entropy", start + r["high"] + WINDOW))).otherwise(no_spans()))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | match.rlike(pattern)
    return F.when(allowed, no_spans()).otherwise(spans)


def base_spans(text: Column) -> Column:
    """By start, then kind."""
    assign = regex_spans(text, ASSIGN, 0, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, regex_spans(text, ACCESS, 1, "access"), regex_spans(text, HEX, 2, "hex")))


def entropy_spans(text: Column) -> Column:
    return located(text, CANDIDATE, lambda m, a, b, _: _entropy_spans(m, a))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns and secret_base, secret_spans: arrays of (start, rank, kind, end)."""
    keep, (held,) = [f"`{c}`" for c in df.columns if c not in ("secret_base", "secret_spans")], free(df, "secret")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # two columns of one struct, so that the base scan runs once
    both = bind(base_spans(whole), lambda base: F.struct(base.alias("secret_base"), F.array_sort(F.concat(base, entropy_spans(whole))).alias("secret_spans")))
    return df.select(*keep, both.alias(held)).select(*keep, f"{held}.*")


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.col("secret_base")
    counts = [count_kind(base, k).alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select(f"`{key}`", *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("secret_spans")).alias("spans"))
