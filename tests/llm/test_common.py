from pyspark.sql import functions as F
from tests.llm.helpers import docs

from docengine.llm import common


def test_spread(spark, sf_dir):
    few = spark.range(100).coalesce(1)
    assert common.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(50)
    assert common.spread(many) is many
    plan = common.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_spans(spark):
    df = docs(spark, ["a1b22", "é1 22é333", "", "none"])
    got = df.select(common.joined_spans(common.regex_spans(F.col("text"), "[0-9]+", 0, "n")).alias("s")).collect()
    assert [r.s for r in got] == ["n:1:2,n:3:5", "n:1:2,n:3:5,n:6:9", "", ""]


def test_materialize(spark):
    df = spark.createDataFrame([(1, [2, 3], None)], "a long, b array<int>, c string")
    again = common.materialize(df)
    assert again.schema.simpleString() == df.schema.simpleString() and again.collect() == df.collect()
    assert common.materialize(df.limit(0)).count() == 0


def test_running_sums(spark):
    import random

    rng = random.Random(2)
    lists = [[], [5], list(range(255)), list(range(256)), list(range(257)), [rng.randrange(9) for _ in range(5000)], [1] * 70_000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    for r in df.where("size(x) > 0").select("i", common.running_sums(F.col("x")).alias("s")).collect():
        total, want = 0, []
        for x in lists[r.i]:
            total += x
            want.append(total)
        assert r.s == want


def test_free_names(spark):
    assert common.free(spark.createDataFrame([(1, 2)], "_A long, b long"), "_a", "_a", "c") == ["_a_", "_a__", "c"]


def test_released():
    """In a process of its own, as a worker is: small pieces that stay keep the allocator from giving back what lies between them."""
    import subprocess
    import sys

    code = """
import re, sys
from docengine.llm import common
def held():
    return int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
def results():
    pieces = [b"%900d" % i for i in range(100_000)]
    stay.extend(pieces[::100])
    yield len(pieces)
stay, before = [], held()
assert list(getattr(common, sys.argv[1], iter)(results())) == [100_000]
print(held() - before)
"""
    more = {name: float(subprocess.run([sys.executable, "-c", code, name], capture_output=True, text=True, check=True).stdout) for name in ("released", "nothing")}
    assert more["released"] < 20 < 60 < more["nothing"]
