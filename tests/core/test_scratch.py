import os

import pytest
from pyspark.sql import functions as F

from docengine.sources import scratch
from docengine.streaming import latest


def test_tables_go_with_their_scope(spark):
    with scratch.scope(spark):
        kept = scratch.materialize(spark.range(3))
        with scratch.scope(spark):
            inner = scratch.materialize(kept.select(F.col("id") * 2))
        path = inner._scratch_path.removeprefix("file:")
        assert kept.count() == 3 and not os.path.exists(path)
        other = scratch.materialize(spark.range(2))
        scratch.discard(other)
    assert not os.path.exists(kept._scratch_path.removeprefix("file:")) and not os.path.exists(other._scratch_path.removeprefix("file:"))


def test_few_files_without_checksums(spark):
    kept = scratch.materialize(spark.range(100, numPartitions=20), files=3)
    names = os.listdir(kept._scratch_path.removeprefix("file:"))
    assert sum(n.startswith("part-") for n in names) == 3 and not any(n.endswith(".crc") for n in names)
    assert sorted(r.id for r in kept.collect()) == list(range(100))
    scratch.discard(kept)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_follow_goes_on_where_it_stopped(spark, tmp_path):
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    schema = "k string, n long, v string"

    def state():
        stream = latest.latest(latest.read_log(spark, source, schema), ["k"], ["n"], "v")
        return {r.k: r.v for r in latest.follow(stream, ["k"], out, at).collect()}

    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z")], schema).coalesce(1).write.parquet(source)
    assert state() == {"a": "z", "b": "y"}
    spark.createDataFrame([("a", 2, "old"), ("b", 2, "w"), ("c", 1, "c")], schema).coalesce(1).write.mode("append").parquet(source)
    assert state() == {"a": "z", "b": "w", "c": "c"}
