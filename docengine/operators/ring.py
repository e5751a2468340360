"""Consistent hashing as data: tokens, owners, replica sets, membership changes and the moves that they cause.

A token is the MD5 of "<node>:<i>", i from 0 to 99, as 32 lower-case hexadecimal digits, which sort like the number. A
key belongs to the nodes met from the first token above its hash onwards, around the ring, each node once. Between two
tokens that is one list, so the ring is a table of intervals, rebuilt when membership changes. The intervals are cut at
hash prefixes, so that keys find theirs by an equi-join on the prefix with a handful of rows each, not by comparing every
key with every token.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VNODES, REPLICATION = 100, 3
#: The intervals are broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_INTERVALS = 200_000


def token(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


@dataclass(frozen=True)
class Ring:
    """An immutable membership. nodes: names with their addresses (host, port)."""

    nodes: tuple[str, ...]
    replication: int = REPLICATION
    addresses: dict = field(default_factory=dict, compare=False)
    local: str | None = None

    @classmethod
    def of(cls, *nodes: str, replication: int = REPLICATION, **options) -> Ring:
        return cls(tuple(nodes), replication, **options)

    def add(self, node: str, host: str | None = None, port: int | None = None) -> Ring:
        if node in self.nodes:
            raise ValueError(f"{node!r} is a member already")
        return Ring((*self.nodes, node), self.replication, self.addresses | ({node: (host, port)} if host else {}), self.local)

    def remove(self, node: str) -> Ring:
        if node not in self.nodes:
            raise ValueError(f"{node!r} is not a member")
        if node == self.local:
            raise ValueError("the local node cannot be removed")
        return Ring(tuple(n for n in self.nodes if n != node), self.replication, {n: a for n, a in self.addresses.items() if n != node}, self.local)

    def address(self, node: str) -> str:
        if node not in self.addresses:
            raise ValueError(f"no address of {node!r}")
        host, port = self.addresses[node]
        return f"http://{host}:{port}"

    def tokens(self) -> list[tuple[str, str]]:
        return sorted((token(f"{n}:{i}"), n) for n in self.nodes for i in range(VNODES))

    def intervals(self) -> list[tuple[str, str, list[str]]]:
        """(low, high, replicas): keys with low <= hash < high. Above 'f...f' lies 'g'."""
        tokens = self.tokens()
        if not tokens:
            return []
        want = min(self.replication, len(self.nodes))

        def walk(start: int) -> list[str]:
            found: list[str] = []
            for k in range(len(tokens)):
                node = tokens[(start + k) % len(tokens)][1]
                if node not in found:
                    found.append(node)
                    if len(found) == want:
                        break
            return found

        edges = ["", *dict.fromkeys(t for t, _ in tokens), "g"]
        order = [t for t, _ in tokens]
        return [(low, high, walk(bisect.bisect_right(order, low) % len(tokens)) if low else walk(0)) for low, high in zip(edges, edges[1:])]

    def replicas_of(self, key: str) -> list[str]:
        """The replica set of one key, on the driver."""
        h = token(key)
        return next((r for low, high, r in self.intervals() if low <= h < high), [])

    def tokens_frame(self, spark: SparkSession) -> DataFrame:
        """The tokens, made by Spark from the nodes alone."""
        nodes = spark.createDataFrame([(n,) for n in self.nodes], "node string")
        each = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(VNODES - 1))).alias("i"))
        return each.select(F.md5(F.concat_ws(":", "node", F.col("i").cast("string")).cast("binary")).alias("tok"), "node")

    def place(self, df: DataFrame, key: Column, into: str = "replicas") -> DataFrame:
        """df with the replica set of each key (null counts as the empty text); without nodes the set is empty."""
        return _placed(df, key, [(low, high, (nodes,)) for low, high, nodes in self.intervals()] or [("", "g", ([],))], (into,))


def _placed(df: DataFrame, key: Column, found: list[tuple[str, str, tuple[list[str], ...]]], names: tuple[str, ...]) -> DataFrame:
    """df with the values of the interval that each key's hash lies in.

    The intervals become a table with one row per interval and hash prefix that it touches; prefixes are long enough for a
    prefix to have a row or two. Keys meet it in an equi-join on the prefix.
    """
    digits = 1
    while 16**digits < len(found) and digits < 8:
        digits += 1
    rows = []
    for low, high, values in found:
        first = int((low or "0" * digits)[:digits], 16)
        last = 16**digits - 1 if high == "g" else int(high[:digits], 16)
        rows += [(format(p, f"0{digits}x"), low, high, *values) for p in range(first, last + 1)]
    columns = [f"_value{i}" for i in range(len(names))]
    table = df.sparkSession.createDataFrame(rows, "_at string, _low string, _high string, " + ", ".join(f"{c} array<string>" for c in columns))
    if len(rows) <= BROADCAST_INTERVALS:
        table = F.broadcast(table)
    # never null, so that the join needs no test for it and the hash is computed once
    hashed = df.withColumn("_hash", F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")))
    at = (F.substring("_hash", 1, digits) == F.col("_at")) & (F.col("_hash") >= F.col("_low")) & (F.col("_hash") < F.col("_high"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return hashed.join(table, at).select(*kept, *(F.col(c).alias(n) for c, n in zip(columns, names)))


def _both(before: Ring, after: Ring) -> list[tuple[str, str, tuple[list[str], ...]]]:
    """The intervals of two rings, cut at the tokens of either, with both replica sets."""
    sides = [r.intervals() or [("", "g", [])] for r in (before, after)]
    edges = sorted({low for side in sides for low, _, _ in side}) + ["g"]
    lows = [[low for low, _, _ in side] for side in sides]
    return [(low, high, tuple(side[bisect.bisect_right(own, low) - 1][2] for side, own in zip(sides, lows))) for low, high in zip(edges, edges[1:])]


def primary(replicas: Column) -> Column:
    return F.get(replicas, F.lit(0))


def balance(placed: DataFrame, replicas: str = "replicas") -> DataFrame:
    """How many keys each node is the first owner of."""
    return placed.groupBy(primary(F.col(replicas)).alias("node")).count()


def migration_plan(before: Ring, after: Ring, keys: DataFrame, key: str) -> DataFrame:
    """key, source, target: copies that a change of members calls for; the source is the first old owner that stays.

    A key's new owners less its old ones: that is the anti-join of the two placements, taken within the row, so no
    shuffle is needed. Intervals whose owners stay the same are left out, so keys that stay drop out in the join. Old
    owners keep their copies; drops() lists them.
    """
    moved = [x for x in _both(before, after) if set(x[2][1]) - set(x[2][0])] or [("", "0", ([], []))]
    both = _placed(keys.select(key), F.col(key), moved, ("old", "new"))
    stays = F.array(*(F.lit(n) for n in after.nodes)) if after.nodes else F.array().cast("array<string>")
    kept = F.filter("old", lambda n: F.array_contains(stays, n))
    source = F.coalesce(F.get(kept, F.lit(0)), F.get("old", F.lit(0)))
    return both.select(F.col(key).alias("key"), source.alias("source"), F.explode(F.array_except("new", "old")).alias("target"))


def drops(before: Ring, after: Ring, keys: DataFrame, key: str) -> DataFrame:
    """key, node: copies that are no longer owned after a change."""
    moved = [x for x in _both(before, after) if set(x[2][0]) - set(x[2][1])] or [("", "0", ([], []))]
    both = _placed(keys.select(key), F.col(key), moved, ("old", "new"))
    return both.select(F.col(key).alias("key"), F.explode(F.array_except("old", "new")).alias("node"))


def missing_copies(ring: Ring, held: DataFrame, key: str, node: str) -> DataFrame:
    """key, node: copies that the ring calls for and no node of held (key, node) has; to be pulled from a peer."""
    wanted = ring.place(held.select(F.col(key)).distinct(), F.col(key)).select(F.col(key), F.explode("replicas").alias(node))
    return wanted.join(held.select(key, node), [key, node], "left_anti")
