"""Quality rules: word counts and compression bands.

Base rules count words, symbols, repeated lines and repeated three-word windows. The compression rule takes the
zstandard ratio (compressed by plain size) of the whole document and of each fixed chunk of CHUNK bytes. Both must lie
in a band that depends on the length of what was compressed: below it the text repeats itself, above it is noise. A
document goes if its whole ratio is outside its band, or if more than MAX_CHUNKS of its chunks are outside theirs.

Nulls and empty texts have no words and fail the base rules. Texts are taken whole. Rows are judged one by one, so ties
and repeated rows change nothing; additional columns stay untouched. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docengine.llm.common import released, small

CHUNK, LEVEL, MAX_CHUNKS = 4096, 3, 0.25
#: Bytes below which a row holds, lowest and highest ratio. The shorter the text, the less a compressor finds in it. The
#: limits lie just outside what documents labelled good have: 0.01 to 0.02 below their least, 0.03 to 0.04 above their greatest.
BANDS = (
    (400, 0.50, 0.80), (500, 0.50, 0.77), (600, 0.50, 0.74), (700, 0.50, 0.72), (850, 0.47, 0.70),
    (1000, 0.47, 0.67), (1200, 0.47, 0.66), (1400, 0.47, 0.63), (1700, 0.46, 0.62), (2000, 0.45, 0.61),
    (2400, 0.45, 0.59), (2800, 0.44, 0.58), (3400, 0.44, 0.57), (4000, 0.43, 0.55), (4800, 0.42, 0.55),
    (5700, 0.42, 0.53), (8000, 0.41, 0.53), (11300, 0.40, 0.51), (16000, 0.40, 0.49), (1 << 62, 0.38, 0.48),
)
#: Ten digits take fewer bits than an alphabet, so a text with more than this share of them has lowest ratios of its own
#: (no good document has so many; the greatest share measured is 0.124).
DIGITS, DIGIT_LOWS = 0.2, ((500, 0.40), (1000, 0.38), (2000, 0.35), (4000, 0.32), (16000, 0.28), (1 << 62, 0.24))
#: Base rules (fixed values).
MIN_WORDS, REPEATED_PERCENT, SYMBOLS = 50, 50, b"#*$%&|<>"
#: Texts of up to so many words are counted in plain Python, longer ones with arrays.
FEW_WORDS = 80

_BLANK = b" \t\n\x0b\x0c\r"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    if n <= FEW_WORDS:
        windows = list(zip(ids, ids[1:], ids[2:]))
        count: dict[tuple, int] = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        if len(count) == len(windows):
            return 0
        inside = set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                inside.update((i, i + 1, i + 2))
        return len(inside)
    a, base = np.array(ids, np.int64), len(seen)
    if base < 1 << 21:
        key = (a[:-2] * base + a[1:-1]) * base + a[2:]
    else:  # three ids do not fit into 63 bits: number the pairs first
        _, pair = np.unique(a[:-2] * base + a[1:-1], return_inverse=True)
        key = pair.astype(np.int64) * base + a[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def outside(plain: bytes, packed: int) -> bool:
    size, ratio = len(plain), packed / len(plain)
    low, high = next((lo, hi) for below, lo, hi in BANDS if size < below)
    if ratio < low and size - len(plain.translate(None, b"0123456789")) > DIGITS * size:
        low = next(lo for below, lo in DIGIT_LOWS if size < below)
    return not low <= ratio <= high


def measure(text: str | None, pack) -> tuple:
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _BLANK).decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > REPEATED_PERCENT * n
    ratio, bad = None, None
    if raw:
        whole = len(pack(raw))
        ratio = whole / len(raw)
        if len(raw) <= CHUNK:
            bad = float(outside(raw, whole))
        else:
            cuts = [*range(0, len(raw) - CHUNK // 2, CHUNK), len(raw)]  # a short rest belongs to the last chunk
            chunks = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            bad = sum(outside(c, len(pack(c))) for c in chunks) / len(chunks)
    kept = not failed and not outside(raw, whole) and bad <= MAX_CHUNKS
    return n, chars, symbols, dup, repeated, failed, kept, ratio, bad


def assess(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) and COLUMNS."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in COLUMNS]
    needed = list(dict.fromkeys([*keep, text]))
    source = df.select(*(f"`{c}`" for c in needed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for b in small(batches):
            rows = [measure(t.as_py(), pack) for t in b.column(needed.index(text))]
            out = [pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [()] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(needed.index(c)) for c in keep), *out], [*keep, *COLUMNS])

    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep) + SCHEMA)


def passing(df: DataFrame, text: str = "text") -> DataFrame:
    """df's rows that the rules keep, with all their columns, whatever their names.

    What a worker is given is held in the JVM and in Python at once, so each row travels once and rejected rows don't return.
    """
    place, verdict = df.columns.index(text), COLUMNS.index("kept")
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        return released(b.filter(pa.array([measure(t.as_py(), pack)[verdict] for t in b.column(place)], pa.bool_())) for b in small(batches))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
