"""Version vectors: maps from a node's name to its counter; a missing counter is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUAL, BEFORE, AFTER, CONFLICT = "equal", "before", "after", "conflict"


def empty() -> Column:
    return F.create_map().cast("map<string,bigint>")


def increment(vector: Column, node: Column) -> Column:
    """The vector with one more on the node's counter."""
    own = F.coalesce(vector, empty())
    rest = F.map_filter(own, lambda k, _: k != node)
    return F.map_concat(rest, F.create_map(node, F.coalesce(F.try_element_at(own, node), F.lit(0).cast("bigint")) + 1))


def compare(left: Column, right: Column) -> Column:
    """How left stands to right: equal, before, after or conflict."""
    gaps = F.map_values(F.map_zip_with(F.coalesce(left, empty()), F.coalesce(right, empty()), lambda _, a, b: F.coalesce(a, F.lit(0).cast("bigint")) - F.coalesce(b, F.lit(0).cast("bigint"))))
    ahead, behind = F.exists(gaps, lambda x: x > 0), F.exists(gaps, lambda x: x < 0)
    return F.when(ahead & behind, CONFLICT).when(ahead, AFTER).when(behind, BEFORE).otherwise(EQUAL)


def conflict(left: Column, right: Column) -> Column:
    """Whether either vector has a counter above the other's: compare() gives conflict."""
    return compare(left, right) == CONFLICT


def merge(left: Column, right: Column) -> Column:
    """The larger counter of each node."""
    return F.map_zip_with(F.coalesce(left, empty()), F.coalesce(right, empty()), lambda _, a, b: F.greatest(F.coalesce(a, b), F.coalesce(b, a)))


def as_text(vector: Column) -> Column:
    """node=counter, by node, comma-joined; for results that are compared."""
    entries = F.array_sort(F.map_entries(F.coalesce(vector, empty())))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def strong(w: int, r: int, copies: int) -> bool:
    """Whether every read quorum meets every write quorum."""
    return check_quorum(w, copies) + check_quorum(r, copies) > copies


def check_quorum(size: int, copies: int) -> int:
    if isinstance(size, bool) or not isinstance(size, int) or not 1 <= size <= copies:
        raise ValueError(f"a quorum is 1 to {copies}, not {size!r}")
    return size
