"""Mixing sources to target weights.

Tokens (words) are summed per source. The sources, by code point with null last, weigh 1, 2, 3, 1, ... and share all
tokens of the corpus by weight; a target stops at LIMIT times its source's size and what is left over is shared again,
until no source is above its limit. Each round of sharing is one sum over the table of sources, in integers, so the table
may be as long as a list of hosts; their numbers come from a distributed sort. A document is emitted floor(rate) times, and
once more if a hash of its id, as a number from 0 to 1, is below the rate's fraction. The same input gives the same mix.

Null texts have size 0, null sources are one source, an empty table gives an empty one. Texts are counted whole, however
long. Sources of equal size or limit are told apart by their names; rows with equal ids, repeated rows among them, take the
same decision each; a null id hashes like the empty string. Additional columns travel along; plan() replaces columns of its
own names (size, source_size, target, rate, copies), mix() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import BROADCAST_BYTES, BROADCAST_ROWS, free, materialize

WORD = r"[^\x20\x09-\x0D]+"
LIMIT, WEIGHTS, SEED = 3, (1, 2, 3), "mix"
#: The join with a long table of rates spreads each source over so many keys.
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(per: DataFrame) -> DataFrame:
    """per with number: the place of each source, from 0, by code point, null last. Sorted by ranges, numbered within them."""
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the row below
    placed = materialize(per.orderBy(F.col("source").asc_nulls_last()).select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    offset, before = F.lit(0).cast("long"), 0
    for r in sorted(placed.groupBy("part").count().collect()):  # one row per partition of the sort
        offset = F.when(F.col("part") == r["part"], F.lit(before).cast("long")).otherwise(offset)
        before += r["count"]
    return placed.withColumn("number", offset + F.col("row")).drop("part", "row")


def rates(sizes: DataFrame) -> DataFrame:
    """Per source: source, source_size, target, rate. sizes: source, size."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    per = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("weight", weight)
    per = per.withColumn("limit", (F.col("source_size").cast("decimal(20,0)") * LIMIT).cast("decimal(28,0)"))
    total = per.agg(F.sum(F.col("source_size").cast("decimal(20,0)"))).first()[0] or 0
    full, left, weights, reached = F.lit(False), int(total), 0, -1
    while True:
        n, limits, weights = per.agg(F.count_if(full), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == reached:
            break
        reached, left, weights = n, int(total) - int(limits or 0), int(weights or 0)
        # the share per weight only grows from round to round, so a source that is full stays full
        full = F.col("limit") * F.lit(weights).cast("decimal(10,0)") <= F.col("weight").cast("decimal(2,0)") * F.lit(left).cast("decimal(28,0)")
    share = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(weights or 1))
    per = per.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(share))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0)).alias("rate"))


def coin(key: Column) -> Column:
    """A number in [0, 1) made of 52 bits of the key's hash."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies_of(rate: Column, key: Column) -> Column:
    return (F.floor(rate) + (coin(key) < rate - F.floor(rate)).cast("long")).cast("long")


def _with_rates(df: DataFrame, table: DataFrame, on: str, key: str) -> DataFrame:
    """df with table's column rate beside it (the last one), without moving rows if the table, which was counted, is small."""
    rows, chars = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("source")), F.lit(0))).first()
    source, salt, row_salt = free(df, "of_source", "salt", "row_salt")
    here = table.withColumnRenamed("source", source)
    same = F.col(f"`{on}`").eqNullSafe(F.col(source))
    if rows <= BROADCAST_ROWS and 4 * chars + 32 * rows <= BROADCAST_BYTES:
        return df.join(F.broadcast(here), same, "left").drop(source)
    here = here.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn(row_salt, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SALTS)).cast("int"))
    return salted.join(here, same & (F.col(row_salt) == F.col(salt)), "left").drop(source, salt, row_salt)


def _rated(df: DataFrame, sizes: DataFrame, source: str, key: str) -> tuple[DataFrame, str]:
    """df with a struct of its source's size, target and rate, and that struct's name."""
    (rate,) = free(df, "mix_rate")
    table = rates(sizes).select("source", F.struct("source_size", "target", "rate").alias(rate))
    return _with_rates(df, table, source, key), rate


def plan(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those of keep) with size, source_size, target, rate and copies, which replace columns of these names."""
    own = ("size", "source_size", "target", "rate", "copies")
    keep = [c for c in (df.columns if keep is None else keep) if c not in own]
    needed = dict.fromkeys([*keep, source, key])
    (size,) = free(df, "mix_size")
    rows = df.select(*(f"`{c}`" for c in needed), size_of(F.col(f"`{text}`")).alias(size))
    if text not in needed:  # texts are read once; what is left of them is small
        rows = materialize(rows)
    rated, rate = _rated(rows, rows.select(F.col(f"`{source}`").alias("source"), F.col(size).alias("size")), source, key)
    found = F.col(f"{rate}.rate")
    return rated.select(*(f"`{c}`" for c in keep), F.col(size).alias("size"), f"{rate}.source_size", f"{rate}.target", found.alias("rate"), copies_of(found, F.col(f"`{key}`")).alias("copies"))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus: df's rows, each as often as it is taken."""
    sizes = df.select(F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size"))
    rated, rate = _rated(df, sizes, source, key)
    (copy,) = free(rated, "copy")
    copies = copies_of(F.col(f"{rate}.rate"), F.col(f"`{key}`")).cast("int")
    return rated.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*(f"`{c}`" for c in df.columns))
