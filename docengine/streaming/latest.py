"""The log of operations as a stream: the newest state per key, kept up to date. An extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, as they come; of a single file, that file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return spark.readStream.schema(schema).parquet(path)


def latest(ops: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the value of the newest row. The state holds one row per key, whatever the stream's length."""
    return ops.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def follow(stream: DataFrame, key: list[str], out: str, checkpoint: str) -> DataFrame:
    """Runs a stream of latest() over what is there now and returns the state so far.

    Each batch writes the keys that changed to a folder of its own, so a batch that runs again replaces what it wrote; the
    state of a key is that of its last batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    spark, rest = stream.sparkSession, [c for c in stream.columns if c not in key]
    changes = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*key, "_last.*")
