"""Toxicity by nearest labelled examples.

Fitting takes a sample of the labelled rows of at most FIT_ROWS per class in expectation (every row whose hash lies
below the share that this allows) and counts in how many sampled documents of each class each word occurs. All words of
MIN_DOCS sampled documents or more are terms (the TERMS most telling ones, if they are more). A term weighs (1 + log tf) *
idf * emphasis; the emphasis is small for a word that both classes use alike and grows with the correlation between the
word and the label, as far as that is above its noise. So ordinary words remain features, and the few telling ones lead.
The vectors of the sample's first EXAMPLES per class, by the same hash, clean and toxic ones, go into an inverted index
whose postings are grouped by blocks of BLOCK examples, each term with its largest weight per block. A document's nearest
examples by exact cosine are found block by block: the sum of the largest weights bounds every cosine in a block, blocks
are taken in order of that bound, a few and then more at a time, and those whose bound falls below the K-th best cosine are
not read. The neighbours vote with weights that fall with distance, scaled back to the classes' true sizes; the votes are
mapped to probabilities that were measured by leaving each sampled example out of its own neighbourhood. The neighbours are
returned as evidence.

Documents without any of the terms, null and empty texts among them, get the toxic share of such documents in the
sample. Texts are taken whole. Rows stand alone; ties among neighbours go to the example that comes first. Labels with a
null, and labels without documents, are left out of the fit; a document that is labelled twice counts twice. Without usable
labels every score is 0. The index is bounded by EXAMPLES and TERMS, whatever the corpus; it goes to every worker.
Additional columns travel along, but for columns named score and evidence, which are replaced.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import BROADCAST_ROWS, small

FIT_ROWS, EXAMPLES, TERMS, MIN_DOCS = 6000, 1500, 200_000, 2
#: How many standard errors of a correlation count as noise, and the emphasis of a word that tells nothing, as a share of that.
NOISE, FLOOR = 3.0, 0.1
#: Blocks that are read before the bounds are looked at again, and the share of examples from which a term has a column.
FIRST_BLOCKS, COMMON = 4, 0.1
K, BLOCK, BINS, THRESHOLD = 25, 64, 12, 0.3
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def emphasis(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """The correlation (phi) between a word and the toxic class beyond its noise, and FLOOR of the noise, from counts of documents."""
    total, having = all_toxic + all_clean, toxic + clean
    spread = having * (total - having) * all_toxic * all_clean
    phi = abs(toxic * all_clean - clean * all_toxic) / math.sqrt(spread) if spread else 0.0
    noise = NOISE / math.sqrt(total)
    return FLOOR * noise + max(0.0, phi - noise)


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Index:
    """Terms with their weights, examples, and block-max postings."""

    def __init__(self, terms: dict[str, float], examples: list[tuple[dict[int, float], int, int]], weights: dict[int, float], empty: float):
        """terms: IDF times emphasis; examples: (vector, label, key), in the order of blocks."""
        self.ids = {t: i for i, t in enumerate(sorted(terms))}
        self.idf = np.array([terms[t] for t in sorted(terms)], np.float64)
        self.empty, self.weights = empty, weights
        self.keys = [k for _, _, k in examples]
        self.toxic = [y for _, y, _ in examples]
        self.blocks = (len(examples) + BLOCK - 1) // BLOCK
        rows = [(t, e, w) for e, (vector, _, _) in enumerate(examples) for t, w in vector.items()]
        term, self.example = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
        self.weight = np.array([r[2] for r in rows], np.float64)
        order = np.lexsort((self.example, term))
        term, self.example, self.weight = term[order], self.example[order], self.weight[order]
        # a cell is a term in a block: its largest weight, and where its postings start
        block = self.example // BLOCK
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.cell_start = np.r_[starts, len(term)]
        self.cell_block = block[starts]
        self.cell_most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.term_start = np.searchsorted(term[starts], np.arange(len(terms) + 1))
        self.bins: list[tuple[float, float]] = []
        self.read = 0
        self.columns: np.ndarray | None = None

    def _with_columns(self) -> None:
        """Postings of common terms as columns over the examples by block, made where they are used; the others stay lists."""
        places = self.cell_start[self.term_start]
        common = np.flatnonzero(np.diff(places) > COMMON * max(len(self.keys), 1))
        self.column = np.full(len(self.idf), -1)
        self.column[common] = np.arange(len(common))
        flat = np.zeros((self.blocks * BLOCK, len(common)))
        for i, t in enumerate(common):
            own = slice(places[t], places[t + 1])
            flat[self.example[own], i] = self.weight[own]
        self.columns = flat.reshape(self.blocks, BLOCK, len(common))
        self.column_most = self.columns.max(axis=1)

    def weighed(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms and weights of the unit vector; none without terms."""
        found = Counter(tokens(text))
        terms = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), np.int64, len(found))
        known = terms >= 0
        terms, counts = terms[known], counts[known]
        weights = self.idf[terms]
        often = np.flatnonzero(counts > 1)
        weights[often] *= 1 + np.log(counts[often])
        size = math.sqrt(weights @ weights)
        return (terms, weights / size) if size else (terms[:0], weights[:0])

    def vector(self, text: str | None) -> dict[int, float]:
        """The unit vector; empty without terms."""
        terms, weights = self.weighed(text)
        return dict(zip(terms.tolist(), weights.tolist()))

    def nearest(self, vector: dict[int, float], k: int = K, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a positive cosine, highest first, ties by example."""
        return self.nearest_to(np.fromiter(vector.keys(), np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector)), k, without)

    def nearest_to(self, terms: np.ndarray, q: np.ndarray, k: int = K, without: int = -1) -> list[tuple[float, int]]:
        """nearest() of these terms and weights."""
        if self.columns is None:
            self._with_columns()
        column = self.column[terms]
        common = column >= 0
        across = np.zeros(self.columns.shape[2])
        across[column[common]] = q[common]
        terms = terms[~common]
        first = self.term_start[terms]
        counts = self.term_start[terms + 1] - first
        cells, of = _gathered(first, counts), np.repeat(q[~common], counts)
        block = self.cell_block[cells]
        bound = np.bincount(block, of * self.cell_most[cells], minlength=self.blocks) + self.column_most @ across
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best: list[tuple[float, int]] = []
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            part = order[at : at + step]
            if len(best) == k:
                part = part[bound[part] >= -best[-1][0] - 1e-12]
                if not len(part):
                    break
            at, step = at + step, self.blocks
            self.read += len(part)
            wanted = np.zeros(self.blocks, bool)
            wanted[part] = True
            hit = wanted[block]
            start = self.cell_start[cells[hit]]
            sizes = self.cell_start[cells[hit] + 1] - start
            places = _gathered(start, sizes)
            cos = np.bincount(self.example[places], self.weight[places] * np.repeat(of[hit], sizes), minlength=self.blocks * BLOCK).astype(np.float64, copy=False)
            by_block = cos.reshape(self.blocks, BLOCK)
            for b in part.tolist():  # one by one, as an index of several would copy their columns
                by_block[b] += self.columns[b] @ across
            if without >= 0:
                cos[without] = 0.0
            there = np.flatnonzero(cos > 0)
            if len(there) > k:
                there = there[cos[there] >= np.partition(cos[there], len(there) - k)[len(there) - k]]
            best = sorted([*best, *zip((-cos[there]).tolist(), there.tolist())])[:k]
        return [(min(-c, 1.0), e) for c, e in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours, nearer ones weighing more."""
        yes = no = 0.0
        for cos, e in near:
            w = self.weights[self.toxic[e]] / (1.05 - cos)
            yes, no = (yes + w, no) if self.toxic[e] else (yes, no + w)
        return yes / (yes + no) if yes + no else 0.0

    def calibrate(self, examples: list[tuple[dict[int, float], int, int]]) -> None:
        """Pools equal shares of the examples' own votes, left out of their neighbourhoods, until their toxic shares do not fall."""
        votes = sorted((self.vote(self.nearest(v, without=e)), y) for e, (v, y, _) in enumerate(examples))
        pools: list[list[float]] = []
        for part in np.array_split(np.arange(len(votes)), min(BINS, len(votes))) if votes else []:
            rows = [votes[i] for i in part]
            w = sum(self.weights[y] for _, y in rows)
            pools.append([sum(v * self.weights[y] for v, y in rows), sum(y * self.weights[y] for _, y in rows), w])
            while len(pools) > 1 and pools[-1][1] / pools[-1][2] <= pools[-2][1] / pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.bins = [(v / w, y / w) for v, y, w in pools]

    def probability(self, vote: float) -> float:
        """The measured toxic share at this vote, interpolated."""
        if not self.bins:
            return vote
        return float(np.interp(vote, [b[0] for b in self.bins], [b[1] for b in self.bins]))

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        terms, weights = self.weighed(text)
        near = self.nearest_to(terms, weights) if len(terms) else []
        if not near:
            return self.empty, []
        return min(max(self.probability(self.vote(near)), 0.0), 1.0), near


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int, examples: int) -> tuple[DataFrame, dict[int, float]]:
    """Key, text, label of the sample and whether a row is an example, and how many labelled rows of each class one example stands for."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = {y: min(1.0, rows / n) for y, n in counts.items() if n}
    unit = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shown = {y: min(1.0, examples / counts[y]) for y in share}
    taken = example = F.lit(False)
    for y, s in share.items():
        taken = taken | ((F.col("label") == y) & (unit < s))
        example = example | ((F.col("label") == y) & (unit < shown[y]))
    few = usable.where(taken).withColumn("example", example)
    # 2 * FIT_ROWS rows in expectation, but a document may be labelled often: counted before it is sent to every executor
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(few, "key"), {y: 1 / s for y, s in shown.items()}


def _counted(sample: DataFrame) -> DataFrame:
    """Per term: in how many documents of each class it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[y].update(set(tokens(text)))
            both = list(found[1].keys() | found[0].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([found[0][t] for t in both], pa.int64()), pa.array([found[1][t] for t in both], pa.int64())], ["term", "clean", "toxic"])

    return sample.select("text", "label").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, examples: int = EXAMPLES) -> Index | None:
    """The index of a bounded sample of the labelled rows; None if there are none."""
    sample, stands = _sample(docs, labels, key, text, label, rows, min(rows, examples))
    if not stands:
        return None
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes:
        return None
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    gap = F.abs(F.col("toxic") * F.lit(float(clean)) - F.col("clean") * F.lit(float(toxic)))
    told = _counted(sample).where((F.col("toxic") + F.col("clean")) >= MIN_DOCS).orderBy((gap / F.sqrt(F.col("toxic") + F.col("clean"))).desc(), "term").limit(TERMS)
    total = clean + toxic
    # at most TERMS rows, of words that the bounded sample has
    terms = {r.term: (math.log((total + 1) / (r.toxic + r.clean + 1)) + 1) * emphasis(r.toxic, r.clean, toxic, clean) for r in told.collect()}

    draft = Index(terms, [], {}, 0.0)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(draft))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(shipped.value)
        for b in small(batches):
            found = [index.vector(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([list(v) for v in found], pa.list_(pa.int32())), pa.array([list(v.values()) for v in found], pa.list_(pa.float64()))], ["key", "label", "terms", "weights"])

    found = sample.where("example").select("key", "text", "label").mapInArrow(vectors, "key long, label int, terms array<int>, weights array<double>").collect()  # the bounded sample
    found.sort(key=lambda r: (r.key, r.label))
    silent = Counter(r.label for r in found if not r.terms)
    weigh = sum(n * stands[y] for y, n in silent.items())
    empty = silent[1] * stands.get(1, 0.0) / weigh if weigh else 0.0
    # examples with the same strongest terms share blocks, so that block maxima are tight
    shown = sorted(((dict(zip(r.terms, r.weights)), r.label, r.key) for r in found if r.terms), key=lambda e: (max(e[0], key=lambda t: (e[0][t], -t)), e[2]))
    index = Index(terms, shown, stands, empty)
    index.calibrate(shown)
    return index


_loaded: dict[str, Index | None] = {}


def score(df: DataFrame, index: Index | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and score (0 to 1) and evidence: the neighbours' ids, labels and cosines."""
    spark = df.sparkSession
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("score", "evidence")]
    needed = list(dict.fromkeys([*keep, text]))
    source = df.select(*(f"`{c}`" for c in needed))
    packed = pickle.dumps(index)
    name, shipped = hashlib.sha256(packed).hexdigest(), spark.sparkContext.broadcast(packed)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = pickle.loads(shipped.value)
        own = _loaded[name]
        for b in small(batches):
            rows = [own.score(t) if own else (0.0, []) for t in b.column(needed.index(text)).to_pylist()]
            near = [x for _, found in rows for x in found]
            fields = [pa.array([own.keys[e] for _, e in near], pa.int64()), pa.array([own.toxic[e] for _, e in near], pa.int32()), pa.array([c for c, _ in near], pa.float64())]
            ends = np.cumsum([0, *(len(found) for _, found in rows)]).astype(np.int32)
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(b.column(needed.index(c)) for c in keep), pa.array([r[0] for r in rows], pa.float64()), evidence], [*keep, "score", "evidence"])

    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep) + "score double, evidence array<struct<id:long,toxic:int,cosine:double>>")
