"""A collection as a relation over its operations: put, delete, batch, drop, replay, compare-and-set, compaction.

An operation is a row: seq, op ('put' or 'delete'), collection, id, data, version_vector, timestamp. The visible state is
the newest operation per (collection, id) by (timestamp, seq), if it is a put. The newest is found by an aggregate with
map-side partials, so a key with a third of all operations sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import versions

KEY = ("collection", "id")
PUT, DELETE = "put", "delete"


def operations(docs: DataFrame, op: str, seq: Column) -> DataFrame:
    """Rows of the log from envelopes (id, collection, data, version_vector, timestamp)."""
    return docs.select(seq.cast("bigint").alias("seq"), F.lit(op).alias("op"), *docs.columns)


def newest(ops: DataFrame, key=KEY) -> DataFrame:
    """The newest operation of each key, deletes included."""
    rest = [c for c in ops.columns if c not in key]
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct("timestamp", "seq")).alias("_last")
    return ops.groupBy(*key).agg(last).select(*key, "_last.*").select(*ops.columns)


def replay(ops: DataFrame, key=KEY) -> DataFrame:
    """The visible documents: the newest operation of each key, if it is a put."""
    return newest(ops, key).where(F.col("op") != DELETE)


def drop_collection(ops: DataFrame, collection: str) -> DataFrame:
    return ops.where(~F.col("collection").eqNullSafe(collection))


def compare_and_set(state: DataFrame, updates: DataFrame) -> DataFrame:
    """updates with accepted: whether the vector they expect is the current one (no document: the empty vector).

    updates: collection, id, expected (vector) and whatever they carry.
    """
    current = state.select(*KEY, F.col("version_vector").alias("_current"))
    joined = updates.join(current, list(KEY), "left")
    return joined.withColumn("accepted", versions.compare(F.col("_current"), F.col("expected")) == versions.EQUAL).drop("_current")


def compact(ops: DataFrame, files: int = 1, keep_deletes: bool = True) -> DataFrame:
    """The same state in fewer rows, ordered by key within files that hold ranges of keys.

    Deletes may go only if nothing older than these operations is kept elsewhere.
    """
    rows = newest(ops)
    if not keep_deletes:
        rows = rows.where(F.col("op") != DELETE)
    return rows.repartitionByRange(files, *KEY).sortWithinPartitions(*KEY)


#: Compaction: so many files of level 0, or more than so many MB of a level, ten times as many on each further level.
LEVEL_0_FILES, BASE_MB, MULTIPLIER = 4, 10, 10


def level_of(name: Column) -> Column:
    """The level in a file's name L<level>_<number>; null without one."""
    found = F.regexp_extract(name, r"(?:^|/)L(\d+)_\d+[^/]*$", 1)
    return F.when(found != "", found.cast("int"))


def compaction_plan(files: DataFrame, level_0_files: int = LEVEL_0_FILES, base_mb: int = BASE_MB, multiplier: int = MULTIPLIER) -> DataFrame:
    """files (name, size) with level, pick and to_level: what the next compaction reads, and the level that it writes.

    All of level 0 if it has level_0_files files or more; else, of the lowest level above its size, the first file, and
    with it all files of the next level.
    """
    placed = files.withColumn("level", level_of(F.col("name"))).where("level is not null")
    levels = placed.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("size") / (1 << 20))).alias("mb"), F.min("name").alias("first"))
    most = F.lit(base_mb) * F.pow(F.lit(multiplier), F.col("level") - 1)
    due = ((F.col("level") == 0) & (F.col("n") >= level_0_files)) | ((F.col("level") > 0) & (F.col("mb") > most))
    chosen = levels.where(due).groupBy().agg(F.min(F.struct("level", "first")).alias("c")).where("c is not null").select(F.col("c.level").alias("from_level"), F.col("c.first").alias("first"))
    joined = placed.join(F.broadcast(chosen), F.lit(True))  # one row
    own = F.col("level") == F.col("from_level")
    pick = F.when(F.col("from_level") == 0, own).otherwise((own & (F.col("name") == F.col("first"))) | (F.col("level") == F.col("from_level") + 1))
    return joined.where(pick).select("name", "size", "level", (F.col("from_level") + 1).alias("to_level"))
