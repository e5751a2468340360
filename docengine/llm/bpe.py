"""Byte-level BPE encoding and decoding.

A text is cut at special tokens and then into short words. For each word two arrays are held side by side: the token
between each pair of part boundaries, and the merge rank of each adjacent pair. The array of ranks is scanned for its
minimum, the boundary there is deleted and the two neighbouring ranks are refreshed, until no pair can be merged. Words
of more than SHORT bytes, for which repeated scans would be quadratic, go through a heap with the same order (lowest
rank, then leftmost).

Nulls and empty texts have no tokens and decode to the empty text. Long texts are encoded whole. Every row is encoded by
itself, so repeated rows, ties and additional columns change nothing. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docengine.llm.common import released, small

#: Words up to so many bytes are merged with the rank array.
SHORT = 64
#: Words that a worker remembers anew; when they are so many, those before them are forgotten.
REMEMBERED = 200_000
#: How byte-level BPE cuts a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond this code point Unicode versions differ between libraries; the tokenizer file's own rules cut such texts.
SURE = "ԯ"

_NO_PAIR = 1 << 60
_WORDS = regex.compile(WORDS)
_UNSURE = regex.compile(f"[^\x00-{SURE}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def check_supported(spec: dict) -> None:
    """Raises ValueError for a tokenizer file that asks for more than byte-level BPE with added tokens cut out as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    wrong = [f"model {k}" for k, v in plain.items() if (model.get(k) or v) != v] + ["model type"] * (model.get("type") != "BPE")
    if spec.get("normalizer") is not None:
        wrong.append("normalizer")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    wrong += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if wrong:
        raise ValueError(f"this tokenizer file is not supported: {', '.join(wrong)}")


class Codec(dict):
    """Encodes and decodes by one tokenizer file. As a mapping it gives the ids of a word."""

    def __init__(self, file: bytes):
        super().__init__()
        spec = json.loads(file)
        check_supported(spec)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.file, self.rules = file, None
        self.before: dict[str, tuple[int, ...]] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_ids = [vocab[c] for c in letters]
        #: the rank of a pair of tokens, and by rank the token that they make
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * top
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.digits = [str(i) for i in range(top)]

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word)
        if ids is None:
            parts = list(map(self.byte_ids.__getitem__, word.encode()))
            ids = tuple(self.merged(parts) if len(parts) <= SHORT else self.merged_long(parts))
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merged(self, parts: list[int]) -> list[int]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(pair, _NO_PAIR) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NO_PAIR:
                break
            i = ranks.index(low)
            parts[i] = token = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((token, parts[i + 1]), _NO_PAIR)
            if i:
                ranks[i - 1] = rank((parts[i - 1], token), _NO_PAIR)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        rank, made, n = self.ranks.get, self.made, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found, i, *pair) for i, pair in enumerate(zip(parts, parts[1:])) if (found := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j] = made[low], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := rank((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (found, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        if not _UNSURE.search(text):
            return _WORDS.findall(text)
        if self.rules is None:
            from tokenizers import Tokenizer

            self.rules = Tokenizer.from_str(self.file.decode()).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.rules.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.words(text))))
        ids: list[int] = []
        for piece in self.cut.split(text):
            ids += [self.special[piece]] if piece in self.special else chain.from_iterable(map(self.__getitem__, self.words(piece)))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(name: str, file: bytes) -> Codec:
    """A worker builds the tables of a tokenizer once."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(file)
    return _codecs[name]


def _shipped(spark: SparkSession, path: str):
    """The tokenizer's file (some MB whatever the input), read on the driver: executors need not have it."""
    with open(path, "rb") as f:
        file = f.read()
    return hashlib.sha256(file).hexdigest(), spark.sparkContext.broadcast(file)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and the token ids of the text."""
    spark = df.sparkSession
    name, file = _shipped(spark, path)
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    needed = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(name, file.value)
        for b in small(batches):
            out = pa.array([bpe.encode(t) for t in b.column(needed.index(text)).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(needed.index(c)) for c in keep), out], [*keep, ids])

    source = df.select(*(f"`{c}`" for c in needed))
    return source.mapInArrow(lambda batches: released(run(batches)), "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep) + f"`{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and the text that the token ids stand for (null: empty)."""
    spark = df.sparkSession
    name, file = _shipped(spark, path)
    keep = [c for c in (df.columns if keep is None else keep) if c != text]
    needed = list(dict.fromkeys([*keep, ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(name, file.value)
        for b in small(batches):
            out = pa.array([bpe.decode(i or ()) for i in b.column(needed.index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(needed.index(c)) for c in keep), out], [*keep, text])

    source = df.select(*(f"`{c}`" for c in needed))
    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep) + f"`{text}` string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of tokens, and SHA-256 of the decimal ids joined by commas and of the text decoded from them.

    Encodes and decodes in one pass over Arrow batches, so that the ids do not travel to the JVM and back.
    """
    spark = df.sparkSession
    name, file = _shipped(spark, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(name, file.value)
        for b in small(batches):
            counts, id_sums, text_sums = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t)
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
