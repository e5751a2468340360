"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are what \\n separates; lines without a word are left alone. Equal lines are one text, known by two 64-bit hashes.
Two texts are linked if so many edits turn one into the other as EDITS allows for the shorter one's length; given a
threshold, that many at any length. A text belongs to a class of lengths. With t edits, the t + 1 segments of its index
are as long as the class's smallest length lets them be without overlap, half of them counted from its start, half from its
end. If no segment i (from its end of the text) were spared with i edits or fewer outside it, either half would have as
many edits as segments, which is one too many; so the other text, not the shorter, has one of the segments at its place or
at most i away. It looks there in its own class, and in the one below if a text of that class can be near. A shared key
gives a candidate if lengths and words differ by no more than the edits explain, the words as far as one bit per class of
words tells; that is tested inside the join, so most pairs that merely share a segment are never made. Texts of which one
key is that of many have their letters counted as well, for the same test. Candidates are verified by Spark's banded edit
distance over code points.

Of a text, the first occurrence stays (smallest doc_id, then position in the document). Texts are taken in the order of
their first doc_id (ties: smaller text), and a text goes altogether if it is linked to one before it that stays; so what
goes is always near to something that is kept. The document keeps its other lines in order.

Only hashes, keys and counts travel while candidates are searched; the texts of candidates are read again from the
documents. Null texts stay null and have no lines. Rows with a null id come last. Rows that share an id are told apart
by their texts; equal rows keep the same lines. Long texts and lines are taken whole. Additional columns travel along, but
for a column named line_dedup, which is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import bind, discard, free, materialize

#: Code points below which a row holds, edits: one for each doubling from 16, three at most, as an edit is a larger part of a
#: shorter line ("item 1" and "item 2" are two lines). The lengths are multiples of the widths of classes.
EDITS = ((16, 0), (32, 1), (64, 2), (1 << 30, 3))
#: So many hashes of 8 bytes may be broadcast, after they are counted.
BROADCAST_HASHES = 500_000
#: A key that indexes so many texts has their letters counted, by which pairs of a large group that are not near are never made.
CROWD = 64
HAS_WORD = r"[^\x20\x09-\x0D]"
LAST = (1 << 63) - 1


def most(threshold: int | None) -> int:
    return max(t for _, t in EDITS) if threshold is None else threshold


def allowed(length: Column, threshold: int | None) -> Column:
    """Edits between a text of that length and one not shorter: threshold if there is one, else by EDITS."""
    if threshold is not None:
        return F.lit(threshold)
    out = F.lit(EDITS[-1][1])
    for below, t in EDITS[-2::-1]:
        out = F.when(length < below, t).otherwise(out)
    return out


def class_of(length: Column, threshold: int) -> Column:
    """Smallest length of the class. Classes are wider than threshold, so a text is near to those of two at most."""
    few, width = threshold + 1, 8 * (threshold // 8 + 1)
    wide = F.when(length < 8 * few, few).when(length < 8 * max(few, width), width).otherwise(2 * width) if few <= width else F.lit(few)
    return length - length % wide


def _pieces(line: Column, length: Column, least: Column, size: Column, edits: Column, most_: int, shifts: bool, own: bool) -> list[Column]:
    """Keys of the segments of a class with that least length, size and number of edits: at their places (own) and away from them (shifts)."""
    out = []
    for right in (0, 1):
        for i in range((most_ + 2 - right) // 2):
            for shift in range(-i, i + 1):
                if shifts if shift else own:
                    start = (length - size * (i + 1) if right else size * i) + shift
                    inside = edits >= max(2 * i + right, 1)  # so many segments has the half
                    if shift or shifts and own:
                        inside = inside & (start >= 0) & (start + size <= length)
                    out.append(F.when(inside, F.xxhash64(F.lit(2 * i + right), least, F.substring(line, start + 1, size))))
    return out


def with_keys(lines: DataFrame, threshold: int | None) -> DataFrame:
    """lines (line, length, ...) with index and probe: arrays of the keys of its own segments, and of what can equal a segment
    of an indexed text that is not longer, but for the own ones. Places that a text does not have are null.

    What the keys have in common is a column of its own, so that it is computed once.
    """
    cap, line, length = most(threshold), F.col("line"), F.col("length")
    least, below = free(lines, "least", "below")
    placed = lines.withColumn(least, class_of(length, cap)).withColumn(below, class_of(F.greatest(length - allowed(length, threshold), F.lit(0)), cap))
    edits, size, edits_below, size_below = free(placed, "edits", "size", "edits_below", "size_below")
    placed = placed.withColumn(edits, allowed(F.col(least), threshold)).withColumn(edits_below, allowed(F.col(below), threshold))
    placed = placed.withColumn(size, (F.col(least) / (F.col(edits) + 1)).cast("int")).withColumn(size_below, (F.col(below) / (F.col(edits_below) + 1)).cast("int"))
    first = (line, length, F.col(least), F.col(size), F.col(edits), cap)
    second = (line, length, F.col(below), F.col(size_below), F.col(edits_below), cap)
    none = F.array().cast("array<bigint>")
    index, probe = _pieces(*first, shifts=False, own=True), _pieces(*first, shifts=True, own=False)
    lower = F.when(F.col(below) < F.col(least), F.array(*_pieces(*second, shifts=True, own=True))).otherwise(none)
    held = F.col(edits) > 0
    keyed = placed.withColumn("index", F.when(held, F.array(*index)).otherwise(none)).withColumn("probe", F.when(held, F.concat(F.array(*probe), lower) if probe else lower).otherwise(none))
    return keyed.drop(least, below, edits, size, edits_below, size_below)


def word_parity(line: Column) -> Column:
    """64 bits: which hash classes of words, as blanks part them, have an odd number of words in the line."""
    return F.aggregate(F.split(line, " "), F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(F.lit(63)).cast("int"))))


def close(a: Column, b: Column, threshold: int | Column) -> Column:
    """Whether so many edits can explain how the parities differ: an edit takes and gives three words at most."""
    return F.bit_count(a.bitwiseXOR(b)) <= threshold * 3


def letter_counts(line: Column) -> Column:
    """The numbers of code points in 32 classes, modulo 4, as 2 bits of a Gray code each, so that a step of one is one bit."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 32 * 2)
    added = lambda n, low: n.bitwiseXOR(low).bitwiseXOR(F.shiftleft(n.bitwiseAND(low), 1))
    counts = F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda n, c: added(n, one(c)))
    return bind(counts, lambda n: n.bitwiseXOR(F.shiftright(n, 1).bitwiseAND(F.lit(0x5555555555555555))))


def within(a: Column, b: Column, threshold: int, edits: Column | None = None) -> Column:
    """Whether threshold edits turn a into b, or edits where they are given, threshold at most."""
    distance = F.levenshtein(a, b, threshold)  # banded; -1 beyond the threshold
    return (distance >= 0) & (distance <= (F.lit(threshold) if edits is None else edits))


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc (the id, null last), same (tells rows with equal ids apart), pos, line, h1, h2 of lines with a word."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("same"), F.split(F.col(f"`{text}`"), "\n", -1).alias("all"))
    # outer, as for an inner one Spark adds a filter that splits the text twice more; a null text's row has no line and goes
    lines = docs.select(F.coalesce("doc", F.lit(LAST)).alias("doc"), "same", F.posexplode_outer("all").alias("pos", "line")).where(F.col("line").rlike(HAS_WORD))
    return lines.select("doc", "same", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))


def _texts(lines: DataFrame, threshold: int | None) -> DataFrame:
    """Per text: h1, h2, first (smallest doc), n, length, and for texts that can have links words (their parity), index and probe keys."""
    known = lines.select("doc", "h1", "h2", "line", F.length("line").alias("length"))
    # told by the length, not by the index: so all are one projection, which Spark compiles in parts, as it does where a lambda
    # is evaluated; the keys alone became one method that is too long for the JVM to compile
    held = allowed(class_of(F.col("length"), most(threshold)), threshold) > 0
    words = F.when(held, word_parity(F.col("line"))).alias("words")
    keyed = with_keys(known, threshold).select("doc", "h1", "h2", "length", "index", "probe", words)
    return keyed.groupBy("h1", "h2", "length", "index", "probe", "words").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))


def _letters(lines: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """h1 and letters of the texts that have a key of CROWD indexed texts or more; null where texts share h1."""
    crowds = materialize(texts.select(F.explode("index").alias("key")).where("key is not null").groupBy("key").count().where(F.col("count") >= CROWD).select("key"))
    few = F.broadcast(crowds) if crowds.count() <= BROADCAST_HASHES else crowds
    members = materialize(rows.join(few, "key", "left_semi").select("h1").distinct())
    few = F.broadcast(members) if members.count() <= BROADCAST_HASHES else members
    texts = lines.join(few, "h1", "left_semi").select("h1", "line").distinct().select("h1", letter_counts(F.col("line")).alias("letters"))
    out = materialize(texts.groupBy("h1").agg(F.when(F.count(F.lit(1)) == 1, F.min("letters")).alias("letters")))
    discard(crowds, members)
    return out


def _candidates(lines: DataFrame, texts: DataFrame, threshold: int | None) -> DataFrame:
    """Pairs a, b of h1 that share a key and whose lengths, words and letters are close."""
    rows = texts.where(F.col("words").isNotNull()).select("h1", "words", "length", "index", F.size("index").alias("own"), F.posexplode(F.concat("index", "probe")).alias("at", "key"))
    # the length and the role (1: probe) as one number
    rows = rows.where("key is not null").select("key", (F.col("length") * 2 + (F.col("at") >= F.col("own")).cast("int")).alias("tag"), "h1", "words", "index")
    letters = _letters(lines, texts, rows.drop("index"))
    rows = rows.join(F.broadcast(letters) if letters.count() <= BROADCAST_HASHES // 2 else letters, "h1", "left")
    rows = rows.withColumn("index", F.when(F.col("letters").isNotNull(), F.array_compact("index")))
    # both sides are one exchange; the condition looks at both, so that it is not pushed below either
    left, right = rows.alias("l"), rows.alias("r")
    role = F.col("l.tag") % 2 * 2 + F.col("r.tag") % 2
    pair = ((role == 0) & (F.col("l.h1") < F.col("r.h1"))) | ((role == 1) & (F.col("l.h1") != F.col("r.h1")))
    one, two = F.shiftright("l.tag", 1), F.shiftright("r.tag", 1)
    edits = allowed(F.least(one, two), threshold)
    # an edit takes and gives a letter at most
    spelt = F.coalesce(F.bit_count(F.col("l.letters").bitwiseXOR(F.col("r.letters"))) <= edits * 2, F.lit(True))
    # texts that share several segments are a pair at the first of them
    once = F.coalesce((role != 0) | (F.get(F.array_intersect("l.index", "r.index"), F.lit(0)) == F.col("l.key")), F.lit(True))
    alike = (F.abs(one - two) <= edits) & close(F.col("l.words"), F.col("r.words"), edits) & spelt & once
    pairs = materialize(left.join(right, (F.col("l.key") == F.col("r.key")) & pair & alike).select(F.col("l.h1").alias("a"), F.col("r.h1").alias("b")).distinct())
    discard(letters)
    return pairs


def _links(lines: DataFrame, pairs: DataFrame, threshold: int | None) -> DataFrame:
    """h1, h2 of a text and before_h1, before_h2 of a linked one that comes before it."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())
    few = F.broadcast(needed) if needed.count() <= BROADCAST_HASHES else needed
    texts = materialize(lines.join(few, "h1", "left_semi").groupBy("h1", "h2", "line").agg(F.min("doc").alias("first")))
    one = texts.select(*(F.col(c).alias(f"a_{c}") for c in texts.columns))
    two = texts.select(*(F.col(c).alias(f"b_{c}") for c in texts.columns))
    met = pairs.join(one, F.col("a") == F.col("a_h1")).join(two, F.col("b") == F.col("b_h1"))
    edits = allowed(F.least(F.length("a_line"), F.length("b_line")), threshold) if threshold is None else None
    met = met.where(within(F.col("a_line"), F.col("b_line"), most(threshold), edits))
    later = F.struct(F.col("a_first"), F.col("a_line")) > F.struct(F.col("b_first"), F.col("b_line"))
    either = lambda x, c: F.when(later if x else ~later, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    links = materialize(met.select(either(True, "h1").alias("h1"), either(True, "h2").alias("h2"), either(False, "h1").alias("before_h1"), either(False, "h2").alias("before_h2")).distinct())
    discard(needed, texts)
    return links


def _gone(links: DataFrame) -> DataFrame:
    """h1, h2 of the texts that are linked to one before them that stays.

    In each round, texts with no link to one before them stay, and those linked to them go, together with all their links.
    The first text of every group stays in the first round, so there are as many rounds as the longest chain of texts needs
    of which each is near to the next one only; groups of copies take one.
    """
    text, before = ["h1", "h2"], ["before_h1", "before_h2"]
    named = lambda df, to: df.select(*(F.col(a).alias(b) for a, b in zip(df.columns, to)))
    gone = None
    while True:
        stays = links.select(*before).distinct().join(named(links.select(*text).distinct(), before), before, "left_anti")
        now = materialize(links.join(stays, before, "left_semi").select(*text).distinct())
        gone = now if gone is None else gone.union(now)
        links = materialize(links.join(now, text, "left_anti").join(named(now, before), before, "left_anti"))
        if not links.limit(1).count():
            return gone


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int | None = None) -> DataFrame:
    """df's columns, the text without the lines that go, and the struct line_dedup (n_lines, n_exact, n_near).

    A threshold holds for all lengths; without one, EDITS do.
    """
    lines = _lines(df, key, text)
    texts = materialize(_texts(lines, threshold))
    pairs = _candidates(lines, texts, threshold)
    near = _gone(_links(lines, pairs, threshold)).withColumn("near", F.lit(True))
    told = texts.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").select("h1", "h2", "first", "n", F.coalesce("near", F.lit(False)).alias("near"))
    # a table of its own, so that the join below is of two exchanges, of which the adaptive planner splits a hot line's
    told = materialize(told.where(F.col("near") | (F.col("n") > 1)))
    discard(texts, pairs)
    hits = lines.select("doc", "same", "pos", "h1", "h2").join(told, ["h1", "h2"])
    hits = hits.select("doc", "same", F.struct("h1", "h2", "pos", "near", (F.col("near") | (F.col("doc") != F.col("first"))).alias("every")).alias("hit"))
    per = hits.groupBy("doc", "same").agg(F.array_sort(F.collect_list("hit")).alias("hits"))  # lines of one document

    def again(x: Column, i: Column) -> Column:
        """Whether the document has this text at an earlier position."""
        last = F.get(F.col("hits"), i - 1)
        return x["every"] | ((i > 0) & (last["h1"] == x["h1"]) & (last["h2"] == x["h2"]) & (last["pos"] < x["pos"]))

    gone = per.select("doc", "same", F.filter("hits", again).alias("gone"))
    near_gone = F.size(F.array_distinct(F.transform(F.filter("gone", lambda x: x["near"]), lambda x: x["pos"])))
    # names that the documents' own columns do not have
    doc, same, out, close_, own_key, own_hash = free(df, "doc", "same", "gone", "near", "key", "hash")
    gone = gone.select(F.col("doc").alias(doc), F.col("same").alias(same), F.transform("gone", lambda x: x["pos"]).alias(out), near_gone.alias(close_))
    own = F.col(f"`{text}`")
    mine = [c for c in df.columns if c != "line_dedup"]
    rows = df.select(*(F.col(f"`{c}`") for c in mine), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias(own_key), F.xxhash64(own).alias(own_hash))
    rows = rows.join(gone, (F.col(own_key) == F.col(doc)) & (F.col(own_hash) == F.col(same)), "left")
    every = F.split(own, "\n", -1)
    left = bind(every, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(out)), lambda i: F.get(ls, i)), "\n"))
    n_gone, n_near = F.coalesce(F.size(F.array_distinct(out)), F.lit(0)), F.coalesce(close_, F.lit(0))
    n_lines = F.coalesce(F.size(F.filter(every, lambda x: x.rlike(HAS_WORD))), F.lit(0))
    stats = F.struct(n_lines.cast("long").alias("n_lines"), (n_gone - n_near).cast("long").alias("n_exact"), n_near.cast("long").alias("n_near"))
    kept = [F.when(F.col(out).isNull(), own).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in mine]
    return rows.select(*kept, stats.alias("line_dedup"))


def summary(deduped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return deduped.select(f"`{key}`", "line_dedup.n_lines", "line_dedup.n_exact", "line_dedup.n_near", F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
