"""Copies of documents on several nodes: newest wins, conflicts, and quorums as data.

A copy is a row: the key, node, replica_pos (its place in the key's replica set), version_vector, timestamp, and whatever
it carries. Live nodes are a list, so a failed node is a node that is not in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import versions
from docengine.operators.ring import Ring


def newest(copies: DataFrame, key: Sequence[str]) -> DataFrame:
    """One copy per key: the greatest timestamp, ties to the earliest place in the replica set."""
    rest = [c for c in copies.columns if c not in key]
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(F.col("timestamp"), -F.col("replica_pos")))
    return copies.groupBy(*key).agg(best.alias("_best")).select(*key, "_best.*").select(*copies.columns)


def siblings(copies: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pairs of copies of one key whose vectors conflict: key, node_a, node_b.

    A key's copies, as many as it has replicas, come together in one aggregate and are compared within the row. Vectors
    that are the same need no comparison.
    """
    each = F.collect_list(F.struct("replica_pos", "node", "version_vector")).alias("_copies")
    held = copies.groupBy(*key).agg(each).select(*key, F.array_sort("_copies", lambda a, b: a["replica_pos"] - b["replica_pos"]).alias("_copies"))
    one = held.select(*key, F.posexplode("_copies").alias("_at", "_a"), "_copies")
    two = one.select(*key, "_a", F.explode(F.slice("_copies", F.col("_at") + 2, F.size("_copies"))).alias("_b"))
    found = two.where(versions.conflict(F.col("_a.version_vector"), F.col("_b.version_vector")))
    return found.select(*key, F.col("_a.node").alias("node_a"), F.col("_b.node").alias("node_b"))


def _live(replicas: Column, live: Sequence[str]) -> Column:
    names = F.array(*(F.lit(n) for n in live)) if live else F.array().cast("array<string>")
    return F.filter(replicas, lambda n: F.array_contains(names, n))


def write(ring: Ring, docs: DataFrame, key: str, live: Sequence[str], w: int = 2) -> DataFrame:
    """docs with replicas, acks and success: a write succeeds with w acknowledgements; fewer leave partial copies."""
    versions.check_quorum(w, ring.replication)
    placed = ring.place(docs, F.col(key))
    acks = F.size(_live(F.col("replicas"), live))
    return placed.withColumn("acks", acks).withColumn("success", (F.size("replicas") >= w) & (acks >= w))


def copies_of(written: DataFrame, live: Sequence[str]) -> DataFrame:
    """A row per copy that a write left behind: node, replica_pos."""
    each = written.withColumn("_copy", F.explode(F.filter(F.transform("replicas", lambda n, i: F.struct(n.alias("node"), i.alias("replica_pos"))), lambda c: c["node"].isin(list(live)) if live else F.lit(False))))
    return each.select(*(c for c in written.columns if c not in ("replicas", "acks", "success")), "_copy.node", "_copy.replica_pos")


def read(copies: DataFrame, key: Sequence[str], live: Sequence[str], r: int = 2) -> DataFrame:
    """One row per key that r live nodes have: the newest copy and replicas_read. Keys below the quorum are left out."""
    if isinstance(r, bool) or not isinstance(r, int) or r < 1:
        raise ValueError(f"a quorum is 1 or more, not {r!r}")
    there = copies.where(F.col("node").isin(list(live))) if live else copies.where(F.lit(False))
    rest = [c for c in copies.columns if c not in key]
    best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(F.col("timestamp"), -F.col("replica_pos")))
    found = there.groupBy(*key).agg(best.alias("_best"), F.count(F.lit(1)).alias("replicas_read")).where(F.col("replicas_read") >= r)
    return found.select(*key, "_best.*", "replicas_read")
