"""Shapes of documents: references, snapshots, embedded lists, trees, statistics and index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(docs: DataFrame, field: str, other: DataFrame, other_id: str, prefix: str) -> DataFrame:
    """docs with the referenced document's fields as prefix_<field>; null where the reference leads nowhere."""
    target = other.select(F.col(other_id).alias("_ref"), *(F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in other.columns))
    return docs.join(target, F.col(field) == F.col("_ref"), "left").drop("_ref")


def snapshot(docs: DataFrame, field: str, other: DataFrame, other_id: str, fields: list[str], into: str) -> DataFrame:
    """docs with a copy of the referenced document's fields as one embedded object."""
    target = other.select(F.col(other_id).alias("_ref"), F.struct(*fields).alias(into))
    return docs.join(target, F.col(field) == F.col("_ref"), "left").drop("_ref")


def embed(docs: DataFrame, doc_id: str, parts: DataFrame, part_ref: str, fields: list[str], into: str, order: list[str]) -> DataFrame:
    """docs with their parts as an embedded list, in the given order; documents without parts get an empty list.

    For one-to-few: the list is one value, so it is bounded by what a document may hold.
    """
    keys = [*order, *(f for f in fields if f not in order)]
    lists = parts.groupBy(F.col(part_ref).alias("_ref")).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("_list"))
    plain = F.transform("_list", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    joined = docs.join(lists, F.col(doc_id) == F.col("_ref"), "left")
    empty = F.array().cast(lists.select(plain.alias("x")).schema["x"].dataType)
    return joined.withColumn(into, F.coalesce(plain, empty)).drop("_ref", "_list")


def unwind(docs: DataFrame, field: str, keep: list[str], outer: bool = False) -> DataFrame:
    """A row per element of an embedded list, with the elements' fields beside the kept ones."""
    each = F.explode_outer if outer else F.explode
    return docs.select(*keep, each(field).alias("_item")).select(*keep, "_item.*")


def tree(nodes: DataFrame, node_id: str, parent_id: str, name: str, depth: int = 64) -> DataFrame:
    """Per node: level (0 at the roots) and path of names from its root; nodes below a cycle or a missing parent are left out.

    A recursive query, so each level is one join. depth bounds the levels; a deeper tree raises an error.
    """
    spark = nodes.sparkSession
    nodes.select(F.col(node_id).alias("id"), F.col(parent_id).alias("parent"), F.col(name).cast("string").alias("name")).createOrReplaceTempView("_tree_nodes")
    return spark.sql(f"""
        WITH RECURSIVE t(id, level, path) MAX RECURSION LEVEL {depth} AS (
          SELECT id, 0, name FROM _tree_nodes WHERE parent IS NULL
          UNION ALL
          SELECT n.id, t.level + 1, concat(t.path, '/', n.name) FROM _tree_nodes n JOIN t ON n.parent = t.id
        ) SELECT id, level, path FROM t""")


def statistics(docs: DataFrame, by: list[str], value: Column) -> DataFrame:
    """n, mean, low and high of a value per group; values are summed as exact decimals, so the order of rows is no matter."""
    exact = value.cast("decimal(18,6)")
    mean = F.sum(exact).cast("double") / F.count(exact)
    return docs.groupBy(*by).agg(F.count(exact).alias("n"), mean.alias("mean"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))


def index_table(docs: DataFrame, field: str, doc_id: str) -> DataFrame:
    """A secondary index as a table of (value as text, id), ordered by value so that files hold ranges of values."""
    pairs = docs.where(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value"), F.col(doc_id).alias("id"))
    return pairs.repartitionByRange("value", "id").sortWithinPartitions("value", "id")


def lookup(docs: DataFrame, doc_id: str, index: DataFrame, value: str) -> DataFrame:
    """The documents that the index lists under a value."""
    return docs.join(index.where(F.col("value") == str(value)), docs[doc_id] == index["id"], "left_semi")
