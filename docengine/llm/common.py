"""What several corpus operators share: tables, free names, Arrow batches and regex spans."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.sources.scratch import discard, materialize, scope  # noqa: F401

#: Rows in an Arrow batch that goes to Python; long documents make large rows.
BATCH_ROWS = 1000
#: Matches whose places are summed one by one; longer lists are summed by blocks of so many first.
RUN = 256
#: A table is broadcast by this library only if it was counted and has no more rows and bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files make fewer partitions than there are cores; such input is small, so moving it is cheap."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of BATCH_ROWS rows, so that what a worker makes of one does not follow the session's setting."""
    for b in batches:
        for start in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(start, BATCH_ROWS)


def released(results: Iterator) -> Iterator:
    """The results; after the last one, memory that the worker has no more use for goes back to the machine.

    Workers outlive their tasks, and what their allocators hold would count in every later stage.
    """
    yield from results
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A span: code points from start to before end; rank is the place of its kind in the operator's list.
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))


def no_spans(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def bind(value: Column, use) -> Column:
    """use(value), where value is computed once however often use() mentions it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, op, zero: Column) -> Column:
    """zero op the first value, that op the second, and so on; op is associative and zero has the values' type.

    An array grows by copying, so results are taken within blocks of RUN elements, then over the blocks' last ones, and
    put together: n elements cost n * RUN + (n / RUN) ** 2 copies of a number, not n ** 2.
    """

    def plain(xs: Column) -> Column:
        start = F.struct(zero.alias("last"), F.slice(F.array(zero), 1, 0).alias("all"))
        step = lambda acc, x: bind(op(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))
        return F.aggregate(xs, start, step, lambda acc: acc["all"])

    def by_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: plain(F.slice(xs, i * RUN + 1, RUN)))

        def joined(parts: Column) -> Column:
            lasts = plain(F.transform(parts, lambda p: F.element_at(p, -1)))
            return bind(lasts, lambda t: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: op(F.when(i > 0, F.get(t, i - 1)).otherwise(zero), x)))))

        return bind(blocks, joined)

    return bind(values, lambda xs: F.when(F.size(xs) <= RUN, plain(xs)).otherwise(by_blocks(xs)))


def running_sums(steps: Column) -> Column:
    """The sums of the elements up to and with each one."""
    return running(steps, lambda a, b: a + b, F.lit(0))


def located(text: Column, pattern: str, emit, kind: str = SPAN) -> Column:
    """All that emit(match, start, end, piece before) gives for the leftmost non-overlapping matches of pattern, in one array.

    The pieces between the matches and the matches themselves, taken alternately, make up the text; the running sums of
    their lengths in code points give the positions. Texts without a match are read once.
    """

    def walk(matches: Column, pieces: Column) -> Column:
        ends = running_sums(F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)))
        return bind(ends, lambda e: F.flatten(F.transform(matches, lambda m, i: bind(F.get(e, i), lambda end: emit(m, end - F.length(m), end, F.get(pieces, i))))))

    def found(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, bind(F.split(text, pattern, -1), lambda pieces: walk(matches, pieces))).otherwise(no_spans(kind))

    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def regex_spans(text: Column, pattern: str, rank: int, kind: str, passes=None) -> Column:
    """The matches of pattern, of those that passes(match) allows, as spans."""
    return located(text, pattern, lambda m, a, b, _: F.array(span(a, rank, kind, b)) if passes is None else F.when(passes(m), F.array(span(a, rank, kind, b))).otherwise(no_spans()))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def any_case(letters: str) -> str:
    """A pattern for ASCII letters in either case, without the flag that engines read differently beyond ASCII."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in letters)
