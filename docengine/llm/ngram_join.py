"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles of SHINGLE words. Documents with equal sets are one
node; the rest of the work is on nodes. Two nodes link when their sets' Jaccard similarity is at least NUMERATOR / 100.

1. One pass over the texts gives each document's set size and the set's hash, and corpus-wide counts of the frequent
   shingles. The global shingle order is: the most frequent ones (at most HEAVY, by count) last, all others before them by
   hash. The order only steers the work; any order gives the same links.
2. By that order, nodes that link share much of their prefixes (the first quarter of a set). A second pass cuts the order
   into fragments by ranges of hashes and sends each prefix entry, packed with others, to its fragment. Each fragment
   counts, for the pairs that meet in it, how many prefix shingles they share. Pairs are counted, then dealt by both nodes to
   units of UNIT_PAIRS on average, whatever the corpus makes of its shingles, and summed there per pair. What lies beyond the prefixes adds a known amount at most, so the sum tells which pairs can link at all. A meeting of more than
   ALL_PAIRS nodes is not expanded: each member is paired with the first CENTRES of a fixed order, and the meeting is kept
   for step 4, which makes up for the counts that are missing so. A shingle that more than SPLIT documents have is dealt to
   several tasks, by node and shingle, so that a group of near copies of any size is bounded in each.
3. Candidates are verified vertically: the sets of their nodes are cut into ranges of hashes, each range counts partial
   overlaps by itself, and the counts are summed per pair. Of the links, a spanning forest per bucket of pairs goes on.
4. Components of the links are found by exchanging the smallest label. In each kept meeting, members that now share a
   component need nothing more; members of different components are counted pair by pair and verified in the same way, so
   no link that would join two components is lost.

Pairs travel packed, many to a row. Documents with no words (null and empty texts) have no set and link with nothing;
fewer words than SHINGLE make one shingle. Rows with a null id take part without lending their id. Repeated rows are
copies of each other. Texts are taken whole; additional columns travel along, but for a column named ngram_join, which is
replaced. An empty table gives an empty table. Sets
are compared by hashes of 64 bits, so two different shingles of a pair are taken for equal once in some 10^13 pairs of
documents of a thousand words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import free, materialize, small

SHINGLE, NUMERATOR = 5, 75
#: Shingles that are last in the order: at most HEAVY, each counted LOCAL times or more in some part of a task's input. Parts
#: hold some thousand documents, so a shingle that is in hundreds of documents of millions is rarely more than twice in one.
HEAVY, LOCAL = 1 << 18, 2
#: Shingles that a task holds before it counts them, and prefix entries before it sends them on.
HELD, PACKED = 1 << 21, 1 << 19
#: Entries, and members of kept meetings, that a fragment gets on average; bytes of all sets for each range and bucket.
FRAGMENT_ENTRIES, FRAGMENT_MEMBERS, CELL_BYTES = 300_000, 50_000, 48 << 20
#: Into how many ranges and buckets at least, and prefix entries for each bucket of pairs.
RANGES, BUCKETS, BUCKET_ENTRIES = 8, 2, 10_000_000
#: Members of one meeting that one task gets; a shingle that is more frequent is dealt to several.
SPLIT = 50_000
#: Meetings of more nodes are not expanded to all pairs at first; each member meets so many of them.
ALL_PAIRS, CENTRES = 64, 4
#: Pairs that one step of counting makes, that are held before they are summed, and that go into a row. Readers take
#: thousands of rows at a time, so rows are of a few KB.
STEP_PAIRS, HELD_PAIRS, ROW_PAIRS = 250_000, 1_000_000, 128
#: Pairs, not yet summed, that one unit gets on average.
UNIT_PAIRS = 500_000
#: Files for each core of a table that texts or prefixes are made into, and rows of the others' files. Each partition would
#: write one, so tables of a few hundred rows would take hundreds of files and tasks.
FILES, FILE_ROWS = 4, 500_000
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000
#: So many bytes of wanted nodes, with the cells that ask for them, may be broadcast, after they are summed.
BROADCAST_BYTES = 24 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
ENTRY = np.dtype([("hash", "<u8"), ("node", "<u8"), ("size", "<u4"), ("rank", "<u4")])
#: A pair's owner comes first in the order of _first(); crossed pairs are those of step 4.
PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("size_a", "<u4"), ("size_b", "<u4"), ("count", "<u4"), ("crossed", "<u4")])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    h = np.zeros(n - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h += w[k : n - SHINGLE + 1 + k] * _ODD[k]
    return np.unique(_mixed(h))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))


def _signed(a) -> np.ndarray:
    return np.asarray(a, np.uint64).view(np.int64)


def needed(a, b):
    """Shared shingles that sets of these sizes need."""
    return -(-NUMERATOR * (a + b) // (100 + NUMERATOR))


def prefix(n: int) -> int:
    """Entries that a set needs among the first of the order to meet every smaller or equal partner."""
    return n - (-(-NUMERATOR * n // 100)) + 1


def _first(nodes: np.ndarray) -> np.ndarray:
    """A fixed order of nodes that has nothing to do with their sets."""
    return _mixed(nodes.copy())


def _files(df: DataFrame, rows: int | None = None) -> int:
    """Into how many files a table goes: FILES for each core, or by its rows, one for each core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return FILES * cores if rows is None else max(cores, math.ceil(rows / FILE_ROWS))


def _described(docs: DataFrame) -> DataFrame:
    """Rows (doc, same, size, node) of documents, and rows (hash, count) of shingles frequent within a part of a task."""
    names = ["doc", "same", "size", "node", "hash", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def frequent() -> pa.RecordBatch:
            hashes, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = counts >= LOCAL
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array(_signed(hashes[often])), pa.array(counts[often].astype(np.int64))], names)

        for b in small(batches):
            sizes, nodes = [], np.zeros(b.num_rows, np.uint64)
            for i, text in enumerate(b.column(2).to_pylist()):
                found = shingles(text)
                sizes.append(len(found))
                nodes[i] = node_of(found) if len(found) else 0
                held.append(found)
                total += len(found)
                if total >= HELD:
                    yield frequent()
                    held, total = [], 0
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(_signed(nodes), mask=np.array(sizes) == 0), none, none], names)
        yield frequent()

    return docs.select("doc", "same", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Entries by hash and node, without repetitions."""
    rows = rows[np.lexsort((rows["node"], rows["hash"]))]
    return rows[np.r_[True, (rows["hash"][1:] != rows["hash"][:-1]) | (rows["node"][1:] != rows["node"][:-1])]] if len(rows) else rows


def _packed(fragment: np.ndarray, rows: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """A row per fragment with its entries' bytes."""
    order = np.argsort(fragment, kind="stable")
    fragment, rows = fragment[order], rows[order]
    keys, starts = np.unique(fragment, return_index=True)
    ends = np.r_[starts[1:], len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], list(names))


def _prefixes(docs: DataFrame, heavy, bits: int) -> DataFrame:
    """Packed prefix entries by fragment: the first bits of their hashes, or a share of one very frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place, deal, offset = heavy.value
        held: list[np.ndarray] = []
        seen: set[int] = set()  # copies of one set make equal entries; one of them is enough
        total = 0

        def send() -> pa.RecordBatch:
            rows = np.concatenate(held)
            fragment = (rows["hash"] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(rows), np.int32)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, rows["hash"]), len(frequent) - 1)
                hot = np.flatnonzero((frequent[at] == rows["hash"]) & (deal[at] > 1))
                # by node and shingle, so that nodes that are apart at one shingle meet at another
                turn = _mixed(rows["node"][hot] ^ rows["hash"][hot]) % deal[at[hot]].astype(np.uint64)
                fragment[hot] = offset[at[hot]] + turn.astype(np.int32)
            return _packed(fragment, rows, ("fragment", "entries"))

        for b in small(batches):
            for text in b.column(0).to_pylist():
                found = shingles(text)
                n = len(found)
                if not n:
                    continue
                node = node_of(found)
                if node in seen:
                    continue
                seen.add(node)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                    known = frequent[at] == found
                    if known.any():
                        late = found[known][np.argsort(place[at[known]], kind="stable")]
                        found = np.concatenate([found[~known], late])
                part = np.empty(prefix(n), ENTRY)
                part["hash"], part["node"], part["size"], part["rank"] = found[: len(part)], node, n, np.arange(len(part))
                held.append(part)
                total += len(part)
                if total >= PACKED:
                    yield send()
                    held, total = [], 0
                    seen.clear()
        if held:
            yield send()

    return docs.mapInArrow(run, "fragment int, entries binary")


def room(size_a, rank_a, size_b, rank_b):
    """Whether sets that share the shingle at these places of theirs can share as many as they need."""
    return np.minimum(rank_a, rank_b) + np.minimum(size_a - rank_a, size_b - rank_b) >= needed(size_a, size_b)


def _pairs(a, b, size_a, size_b, crossed: bool = False) -> np.ndarray:
    """Counted pairs, owners first, of nodes whose sizes allow a link."""
    fine = (a != b) & (NUMERATOR * np.maximum(size_a, size_b) <= 100 * np.minimum(size_a, size_b))
    out = np.empty(int(fine.sum()), PAIR)
    a, b, size_a, size_b = a[fine], b[fine], size_a[fine], size_b[fine]
    swap = _first(a) > _first(b)
    out["a"], out["b"] = np.where(swap, b, a), np.where(swap, a, b)
    out["size_a"], out["size_b"] = np.where(swap, size_b, size_a), np.where(swap, size_a, size_b)
    out["count"], out["crossed"] = 1, crossed
    return out


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One entry per pair, with the sum of its counts; crossed if any of its entries is."""
    if not len(pairs):
        return pairs
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    starts = np.flatnonzero(np.r_[True, (pairs["a"][1:] != pairs["a"][:-1]) | (pairs["b"][1:] != pairs["b"][:-1])])
    out = pairs[starts].copy()
    out["count"] = np.add.reduceat(pairs["count"], starts)
    out["crossed"] = np.maximum.reduceat(pairs["crossed"], starts)
    return out


def _prefixes_of(sizes: np.ndarray) -> np.ndarray:
    n = sizes.astype(np.int64)
    return n - -(-NUMERATOR * n // 100) + 1


def possible(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether pairs that share so many prefix shingles can link.

    Of two prefixes one ends first in the order; shared shingles that were not counted lie beyond that end, in the rest of
    that set.
    """
    a, b = pairs["size_a"].astype(np.int64), pairs["size_b"].astype(np.int64)
    return counts.astype(np.int64) + np.maximum(a - _prefixes_of(a), b - _prefixes_of(b)) >= needed(a, b)


def _met(rows: np.ndarray, all_pairs: int, dealt: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From one fragment's entries: pairs with their counts, and places of the members of kept meetings, in parts.

    A pair may be in several parts. dealt: the fragment is a share of one shingle, whose meeting goes on in other shares and
    so is always kept.
    """
    node, size, rank = rows["node"], rows["size"].astype(np.int64), rows["rank"].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, rows["hash"][1:] != rows["hash"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(rows)])

    def steps() -> Iterator[np.ndarray]:
        few = np.flatnonzero((counts > 1) & (counts <= all_pairs))
        for n in np.unique(counts[few]):
            i, j = np.triu_indices(n, 1)
            groups = starts[few[counts[few] == n]][:, None]
            for part in np.array_split(groups, max(1, len(groups) * len(i) // STEP_PAIRS)):
                a, b = (part + i).ravel(), (part + j).ravel()
                fine = room(size[a], rank[a], size[b], rank[b])
                yield _pairs(node[a[fine]], node[b[fine]], size[a[fine]], size[b[fine]])
        for g in np.flatnonzero(counts > all_pairs):
            at = np.arange(starts[g], starts[g] + counts[g])
            for c in at[np.argsort(_first(node[at]), kind="stable")[:CENTRES]]:
                yield _pairs(np.full(len(at), node[c]), node[at], np.full(len(at), size[c]), size[at])

    found, held = [np.zeros(0, PAIR)], 0
    for pairs in steps():
        found.append(pairs)
        held += len(pairs)
        if held > HELD_PAIRS:
            found = [_summed(np.concatenate(found))]
            held = len(found[0])
            if 2 * held > HELD_PAIRS:
                yield found.pop(), np.zeros(0, np.int64)
                found, held = [np.zeros(0, PAIR)], 0
    yield _summed(np.concatenate(found)), np.flatnonzero(np.repeat(dealt | (counts > all_pairs), counts))


def _bucketed(pairs: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with their pairs, by the pairs' owners."""
    bucket = (_first(pairs["a"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    pairs, bucket = pairs[order], bucket[order]
    keys, starts = np.unique(bucket, return_index=True)
    yield from zip(keys.tolist(), (pairs[x:y] for x, y in zip(starts, [*starts[1:], len(pairs)])))


def _rows(pairs: np.ndarray) -> pa.RecordBatch:
    """Packed pairs (pairs, n), ROW_PAIRS to a row."""
    parts = [pairs[x : x + ROW_PAIRS] for x in range(0, len(pairs), ROW_PAIRS)]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([len(x) for x in parts], pa.int64())], ["pairs", "n"])


def _meetings(prefixes: DataFrame, all_pairs: int, bits: int) -> DataFrame:
    """Packed pairs (pairs, n), and members (hash, share, node, size, rank) of the meetings that were not expanded."""
    names = ["hash", "share", "node", "size", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        fragment = table.column("fragment")[0].as_py()
        rows = _sorted(np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY))
        del table
        for pairs, kept in _met(rows, all_pairs, fragment >= 1 << bits):
            packed, m = _rows(pairs), len(kept)
            if packed.num_rows:
                yield pa.RecordBatch.from_arrays([*packed.columns, *[pa.nulls(packed.num_rows, pa.int64())] * 5], ["pairs", "n", *names])
            if m:
                members = [_signed(rows["hash"][kept].copy()), np.full(m, fragment, np.int64), _signed(rows["node"][kept].copy()), rows["size"][kept].astype(np.int64), rows["rank"][kept].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), *map(pa.array, members)], ["pairs", "n", *names])

    return prefixes.groupBy("fragment").applyInArrow(run, "pairs binary, n long, hash long, share long, node long, size long, rank long")


def _crossed(rows: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
    """Counted pairs of members of one meeting and different components, a few members at a time.

    rows: hash and share, by which they are sorted, node, size, rank, label, main (of the meeting's largest component), turn.
    Rows without a turn are the members of a share; rows with one are members outside the largest component, which take
    their turn against all members of the share, whichever share is their own.
    """
    hashes, share, nodes, sizes, ranks, labels, main, turn = (rows[c] for c in ("hash", "share", "node", "size", "rank", "label", "main", "turn"))
    starts = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (share[1:] != share[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    turns: dict[int, list[tuple[int, np.ndarray]]] = {}
    for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)]):
        there = x + np.flatnonzero(~turn[x:y])
        for i in (x + np.flatnonzero(turn[x:y])).tolist():
            turns.setdefault(int(nodes[i]), []).append((i, there))
    held, total = [], 0
    for places in turns.values():
        at = np.concatenate([there for _, there in places])
        own = np.repeat([i for i, _ in places], [len(there) for _, there in places])
        # of two that both take their turn in a meeting, the smaller counts the pair
        fine = (labels[at] != labels[own]) & (main[at] | (nodes[own] < nodes[at]))
        fine &= room(sizes[own], ranks[own], sizes[at], ranks[at])
        at, own = at[fine], own[fine]
        held.append(_summed(_pairs(nodes[own], nodes[at], sizes[own], sizes[at], crossed=True)))
        total += len(held[-1])
        if total > 500_000:
            yield np.concatenate(held)
            held, total = [], 0
    if held:
        yield np.concatenate(held)


def _unmet(members: DataFrame, state: DataFrame) -> DataFrame:
    """Packed pairs (pairs, n) of members of kept meetings that are in different components."""
    names = ("hash", "share", "node", "size", "rank", "label", "main", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        rows = {c: np.array(table.column(c).to_pylist(), bool) if c in ("main", "turn") else table.column(c).to_numpy() for c in names}
        order = np.lexsort((rows["share"], rows["hash"]))
        rows = {c: v[order] for c, v in rows.items()}
        rows["node"] = rows["node"].view(np.uint64)
        for pairs in _crossed(rows):
            yield _rows(_summed(pairs))

    placed = materialize(members.join(state.select("node", F.col("label.node").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")), _files(members))
    per = placed.groupBy("hash", "label").agg(F.count(F.lit(1)).alias("n"), F.collect_set("share").alias("shares"))
    per = per.groupBy("hash").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"), F.array_distinct(F.flatten(F.collect_list("shares"))).alias("shares"))
    split = materialize(per.where("labels > 1").select("hash", "largest", "shares"), _files(members))
    met = placed.join(split, "hash").withColumn("main", F.col("label") == F.col("largest"))
    there = met.select("hash", "share", "node", "size", "rank", "label", "main", F.lit(False).alias("turn"))
    turns = met.where("not main").select("hash", F.explode("shares").alias("share"), "node", "size", "rank", "label", "main", F.lit(True).alias("turn"))
    fragments = max(1, math.ceil(placed.count() / FRAGMENT_MEMBERS))
    fragment = F.pmod(F.xxhash64("hash", "share"), F.lit(fragments)).alias("fragment")
    return there.union(turns).select(fragment, *names).groupBy("fragment").applyInArrow(run, "pairs binary, n long")


def _units(packed: DataFrame) -> DataFrame:
    """Packed pairs (unit, pairs), dealt by both nodes to as many units as their number asks for."""
    units = max(1, math.ceil(packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / UNIT_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total = 0

        def send() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            return _packed((_mixed(_first(pairs["a"]) ^ pairs["b"]) % np.uint64(units)).astype(np.int32), pairs, ("unit", "pairs"))

        for b in small(batches):
            held.append(np.frombuffer(b"".join(b.column(0).to_pylist()), PAIR))
            total += len(held[-1])
            if total >= HELD_PAIRS:
                yield send()
                held, total = [], 0
        if held:
            yield send()

    return packed.select("pairs").mapInArrow(run, "unit int, pairs binary")


def _candidates(packed: DataFrame, crossed: bool, buckets: int) -> DataFrame:
    """Per unit and bucket: the packed pairs whose summed counts allow a link, and the nodes that they need.

    crossed: only pairs of different components that the first time did not verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column("pairs")), PAIR)
        pairs = _summed(every)
        fine = possible(pairs, pairs["count"])
        if crossed and len(pairs):
            before = every[every["crossed"] == 0]
            once = np.zeros(len(pairs), np.int64)
            if len(before):
                before = _summed(before)
                both = np.concatenate([pairs[["a", "b"]], before[["a", "b"]]])
                order = np.lexsort((both["b"], both["a"]))
                same = np.flatnonzero((both["a"][order][1:] == both["a"][order][:-1]) & (both["b"][order][1:] == both["b"][order][:-1]))
                one, two = np.minimum(order[same], order[same + 1]), np.maximum(order[same], order[same + 1]) - len(pairs)
                once[one] = before["count"][two]
            fine &= (pairs["crossed"] > 0) & ~possible(pairs, once)
        for bucket, own in _bucketed(pairs[fine], buckets):
            nodes = _signed(np.unique(np.concatenate([own["a"], own["b"]])))
            n = len(nodes)
            first = [pa.array([bucket] * (n + 1), pa.int32()), pa.array([own.tobytes()] + [None] * n, pa.binary()), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(nodes)])]
            yield pa.RecordBatch.from_arrays(first, ["bucket", "pairs", "node"])

    return _units(packed).groupBy("unit").applyInArrow(run, "bucket int, pairs binary, node long")


def _asked(asked: pa.Table) -> np.ndarray:
    """A bucket's pairs, which come from several units, in one order wherever they are read."""
    pairs = np.frombuffer(b"".join(asked.column("pairs").to_pylist()), PAIR)
    return pairs[np.lexsort((pairs["b"], pairs["a"]))]


def _parts(docs: DataFrame, ranges: int) -> DataFrame:
    """Per node, range of hashes and bucket (cell) that asks for it: the part of the node's set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for b in small(batches):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for node, text, cells in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = shingles(text)
                cuts = [0, *np.searchsorted(found, edges).tolist(), len(found)]
                for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    if y > x:
                        part = found[x:y].tobytes()
                        for cell in cells:
                            for column, value in zip(out, (node, i, cell, part)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["node", "range", "cell", "part"])

    return docs.mapInArrow(run, "node long, range int, cell int, part binary")


def _overlaps(asked: pa.Table, parts: pa.Table) -> pa.Table:
    """Partial overlaps of a bucket's pairs within one range, in the pairs' order."""
    if not asked.num_rows:
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "shared"])
    pairs = _asked(asked)
    sets = {n: np.frombuffer(p, np.uint64) for n, p in zip(parts.column("node").to_numpy().view(np.uint64).tolist(), parts.column("part").to_pylist())}
    a, b = pairs["a"], pairs["b"].tolist()
    shared = np.zeros(len(pairs), np.uint32)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
        own = sets.get(int(a[s]))
        if own is None:
            continue
        for x in range(s, e, 512):
            at = [i for i in range(x, min(x + 512, e)) if b[i] in sets]
            if at:
                others = [sets[b[i]] for i in at]
                every = np.concatenate(others)
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                shared[at] = np.add.reduceat(hit.astype(np.uint32), np.cumsum([0, *map(len, others[:-1])]))
    return pa.table([asked.column("bucket").slice(0, 1).cast(pa.int32()), pa.array([shared.tobytes()], pa.binary())], ["bucket", "shared"])


def _forest(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """A spanning forest of a bucket's links: the overlaps of all ranges, summed, against what the sizes need."""
    pairs = _asked(asked)
    shared = np.zeros(len(pairs), np.int64)
    for blob in counted.column("shared").to_pylist():
        shared += np.frombuffer(blob, np.uint32)
    links = pairs[shared >= needed(pairs["size_a"].astype(np.int64), pairs["size_b"].astype(np.int64))]
    over: dict[int, int] = {}

    def top(n: int) -> int:
        while (up := over.get(n, n)) != n:
            over[n] = over.get(up, up)
            n = up
        return n

    kept = []
    for i, (a, b) in enumerate(zip(links["a"].tolist(), links["b"].tolist())):
        x, y = top(a), top(b)
        if x != y:
            over[y] = x
            kept.append(i)
    return pa.table([pa.array(_signed(links["a"][kept].copy())), pa.array(_signed(links["b"][kept].copy()))], ["a", "b"])


def _verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, ranges: int) -> DataFrame:
    """Links a, b among the candidates (bucket, pairs, node), as a spanning forest per bucket.

    docs: doc, same, text; nodes: node, doc, same, size, of one document per node.
    """
    asked = candidates.where("pairs is not null").select("bucket", "pairs")
    cells = candidates.where("node is not null").groupBy("node").agg(F.collect_set("bucket").alias("cells"))
    wanted = materialize(nodes.join(cells, "node").select("node", "doc", "same", "cells"), _files(docs))
    held = wanted.agg(F.coalesce(F.sum(F.size("cells") * 4 + 40), F.lit(0))).first()[0]
    few = F.broadcast(wanted) if held <= BROADCAST_BYTES else wanted
    parts = _parts(docs.join(few, ["doc", "same"]).select("node", "text", "cells"), ranges)
    each = asked.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    counted = each.groupBy("range", "bucket").cogroup(parts.groupBy("range", "cell")).applyInArrow(_overlaps, "bucket int, shared binary")
    return asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_forest, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest (doc, node) reachable, for the nodes that have links.

    Each round takes the smallest label among a node's own and its neighbours', and then the label of the label's node,
    so that long chains halve; it ends when no label falls.
    """
    files = _files(links, 2 * links.count())
    both = materialize(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a"))).distinct(), files)
    label = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), F.col("node").alias("node"))
    state = materialize(both.select("node").distinct().join(nodes.select("node", "doc"), "node").select("node", label.alias("label")), files)
    while True:
        near = both.join(state.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = state.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("theirs", "label")).alias("label"))
        step = materialize(step, files)  # so that the next join is of two exchanges, which can be split where a component is large
        jump = step.select(F.col("node").alias("far"), F.col("label").alias("farther"))
        step = step.join(jump, F.col("label.node") == F.col("far"), "left").select("node", "old", F.least("label", F.coalesce("farther", "label")).alias("label"))
        step = materialize(step, files)
        state = step.select("node", "label")
        if step.where("old != label").limit(1).count() == 0:
            return state


def _frequent(spark: SparkSession, described: DataFrame, bits: int, split: int):
    """The hashes that come last, sorted, with their places in the order, the number of tasks that share them, and the first
    of these tasks' fragments; at most HEAVY of them, 32 bytes each."""
    top = described.where("hash is not null").groupBy("hash").agg(F.sum("count").alias("count")).orderBy(F.col("count").desc(), "hash").limit(HEAVY).toPandas()
    hashes, counts = top["hash"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    place = np.empty(len(hashes), np.int64)
    place[np.lexsort((hashes, counts))] = np.arange(len(hashes))
    deal = -(-counts // split)
    offset = (1 << bits) + np.cumsum(deal) - deal
    order = np.argsort(hashes)
    return spark.sparkContext.broadcast((hashes[order], place[order], deal[order], offset[order]))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", all_pairs: int = ALL_PAIRS, split: int = SPLIT) -> DataFrame:
    """Per row of df: doc (the id), same (a hash of the text), size (of the set), component (smallest id reachable by links, its own included)."""
    spark = df.sparkSession
    own, last = F.col(f"`{text}`"), F.lit((1 << 63) - 1)
    docs = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), last).alias("doc"), F.xxhash64(own).alias("same"), own.alias("text"))
    described = materialize(_described(docs), _files(docs))
    rows = described.where("hash is null").select("doc", "same", "size", "node")
    first = F.min(F.struct("doc", "same")).alias("first")
    files = _files(docs, rows.count())
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(first, F.max("size").alias("size")).select("node", "first.doc", "first.same", "size"), files)
    entries, total = nodes.agg(F.coalesce(F.sum(F.floor(F.col("size") / 4) + 1), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # a prefix holds the lowest quarter of a set's hashes, so a quarter of the fragments take nearly all of them
    bits = max(0, math.ceil(math.log2(max(1, 4 * entries / FRAGMENT_ENTRIES))))
    buckets = max(BUCKETS, math.ceil(entries / BUCKET_ENTRIES))
    ranges = min(64, max(RANGES, math.ceil(8 * total / (buckets * CELL_BYTES))))
    met = materialize(_meetings(_prefixes(docs.select("text"), _frequent(spark, described, bits, split), bits), all_pairs, bits), _files(docs))
    pairs, members = met.where("pairs is not null").select("pairs", "n"), met.where("hash is not null").select("hash", "share", "node", "size", "rank")
    links = materialize(_verified(docs, nodes, materialize(_candidates(pairs, False, buckets), _files(docs)), ranges), _files(docs))
    state = components(nodes, links)
    rest = materialize(_unmet(members, state), _files(docs))
    if rest.limit(1).count():
        more = _verified(docs, nodes, materialize(_candidates(pairs.union(rest), True, buckets), _files(docs)), ranges)
        state = components(nodes, links.union(materialize(more, _files(docs))))
    smallest = nodes.join(state, "node", "left").select("node", F.coalesce("label.doc", "doc").alias("component"))
    # a table of its own, so that the join below is of two exchanges, of which the adaptive planner splits a large group's
    smallest = materialize(smallest, files)
    placed = rows.join(smallest, "node", "left").withColumn("component", F.coalesce("component", "doc"))
    known = lambda c: F.when(F.col(c) != last, F.col(c)).alias(c)
    return placed.select(known("doc"), "same", "size", known("component")).coalesce(_files(docs))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df's columns and the struct ngram_join (n_shingles, component)."""
    mine = [c for c in df.columns if c != "ngram_join"]
    doc, same, own_key, own_hash = free(df, "doc", "same", "key", "hash")
    told = classes(df, key, text).distinct().select(F.col("doc").alias(doc), F.col("same").alias(same), F.struct(F.col("size").alias("n_shingles"), "component").alias("ngram_join"))
    rows = df.select(*(f"`{c}`" for c in mine), F.col(f"`{key}`").cast("long").alias(own_key), F.xxhash64(F.col(f"`{text}`")).alias(own_hash))
    met = rows.join(told, F.col(own_key).eqNullSafe(F.col(doc)) & (F.col(own_hash) == F.col(same)), "left")
    return met.select(*(f"`{c}`" for c in mine), "ngram_join").coalesce(_files(df))
