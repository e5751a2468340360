"""Reading collections: Parquet tables, JSON documents, and listings of both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_lines(spark: SparkSession, path: str, collection: str, id_field: str = "_id", timestamp: float = 0.0, node: str = "local") -> DataFrame:
    """Schema-free documents, one JSON object per line: id, collection, data (VARIANT), version_vector, timestamp.

    Lines that are no JSON have null data. Field types stay as they are in each document.
    """
    return from_json_text(spark.read.text(path).where(F.length(F.trim("value")) > 0), "value", collection, id_field, timestamp, node)


def from_json_text(df: DataFrame, column: str, collection: str, id_field: str = "_id", timestamp: float = 0.0, node: str = "local") -> DataFrame:
    data = F.try_parse_json(F.col(column))
    held = df.select(data.alias("data"))
    return held.select(
        F.try_variant_get("data", f"$.{id_field}", "string").alias("id"),
        F.lit(collection).alias("collection"),
        "data",
        F.create_map(F.lit(node), F.lit(1).cast("bigint")).alias("version_vector"),
        F.lit(float(timestamp)).alias("timestamp"),
    )


def collections(keyed: Iterable[tuple[str, DataFrame]], spark: SparkSession) -> DataFrame:
    """The names of collections that hold a document, in order."""
    found = None
    for name, df in keyed:
        one = df.limit(1).select(F.lit(name).alias("collection"))
        found = one if found is None else found.union(one)
    return (found if found is not None else spark.createDataFrame([], "collection string")).orderBy("collection")


def write_sorted(df: DataFrame, path: str, key: str, files: int, mode: str = "overwrite") -> None:
    """Parquet in files that hold ranges of the key, with a Bloom filter on it, so that a point lookup reads little."""
    rows = df.repartitionByRange(files, key).sortWithinPartitions(key)
    rows.write.mode(mode).option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.block.size", str(32 << 20)).parquet(path)
