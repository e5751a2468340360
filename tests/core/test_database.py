import json
import time

import pytest
from pyspark.sql import functions as F

from docengine.operators.ring import Ring
from docengine.sources import tables
from docengine.sources.database import Database, NotFound
from docengine.sources.settings import Settings


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def docs(spark, **items):
    return spark.createDataFrame([(k.strip("_"), json.dumps(v)) for k, v in items.items()], "id string, data string")


def seen(df):
    return {r.id: json.loads(r.data) for r in df.withColumn("data", F.to_json("data")).collect()}


def test_documents(spark, db):
    db.put("users", docs(spark, _1001={"name": "Alice", "age": 30}, _1002={"name": "Bob", "age": 25}))
    assert seen(db.query("users", {"filter": {"age": {"$gt": 25}}})) == {"1001": {"name": "Alice", "age": 30}}
    assert seen(db.query("users", {"filter": {"age": 30}})).keys() == {"1001"}
    body = {"filter": {"age": {"$gte": 25}}, "sort": {"name": -1}, "limit": 10, "offset": 0, "fields": ["name"]}
    assert [r.id for r in db.query("users", body).collect()] == ["1002", "1001"]
    db.put("users", docs(spark, _1001={"name": "Alice B."}))
    one = db.one("users", "1001")
    assert json.loads(one.data) == {"name": "Alice B."} and one.version_vector == {"local": 2}
    db.delete("users", spark.createDataFrame([("1001",), ("nobody",)], "id string"))
    with pytest.raises(NotFound):
        db.one("users", "1001")
    assert seen(db.current("users")).keys() == {"1002"}
    db.put("users", docs(spark, _1001={"back": True}))
    assert seen(db.get("users", "1001")) == {"1001": {"back": True}}


def test_collections(spark, db):
    assert db.collections() == [] and db.raw_keys().count() == 0
    db.put("b", docs(spark, x={"n": 1}))
    db.put("a", docs(spark, **{f"k{i:02d}": {"n": i} for i in range(12)}))
    assert db.collections() == ["a", "b"]
    assert [r.id for r in db.page("a", 5, 10).collect()] == ["k10", "k11"]
    keys = {bytes.fromhex(r.key).decode() for r in db.raw_keys().collect()}
    assert keys == {"b:x", *(f"a:k{i:02d}" for i in range(12))}
    assert seen(db.raw_get(b"b:x".hex())) == {"x": {"n": 1}}
    with pytest.raises(ValueError):
        db.raw_get("zz")
    db.delete("b", spark.createDataFrame([("x",)], "id string"))
    assert db.collections() == ["a"]
    db.drop("a")
    assert db.collections() == []
    with pytest.raises(NotFound):
        db.drop("a")
    with pytest.raises(ValueError):
        db.put("a:b", docs(spark, x={}))


def test_batches_and_conditions(spark, db):
    ops = spark.createDataFrame([(1, "put", "a", '{"n":1}'), (2, "put", "b", '{"n":2}'), (3, "delete", "a", None), (4, "put", "b", '{"n":3}')], "seq long, op string, id string, data string")
    db.write_batch("c", ops)
    assert seen(db.current("c")) == {"b": {"n": 3}}
    tries = spark.createDataFrame([("b", '{"n":4}', {"local": 1}), ("b2", '{"n":5}', {"local": 9}), ("b3", '{"n":6}', {})], "id string, data string, expected map<string,bigint>")
    assert {r.id: r.accepted for r in db.put_if("c", tries).collect()} == {"b": True, "b2": False, "b3": True}
    assert seen(db.current("c")) == {"b": {"n": 4}, "b3": {"n": 6}}


def test_compaction_and_backup(spark, db, tmp_path):
    for i in range(4):
        db.put("c", docs(spark, a={"n": i}, **{f"x{i}": {"n": i}}))
    before = seen(db.current("c"))
    assert db.due() and db.compact() and not db.due()
    assert [s[:3] for s in db.segments()] == ["L1_"] and seen(db.current("c")) == before
    db.delete("c", spark.createDataFrame([("x0",)], "id string"))
    del before["x0"]
    assert not db.compact() and seen(db.current("c")) == before
    assert db.compact(whole=True) and len(db.segments()) == 1 and seen(db.current("c")) == before
    assert db.log("c").where("op = 'delete'").count() == 0
    db.backup(str(tmp_path / "copy"))
    db.drop_all()
    assert db.collections() == [] and not db.compact(whole=True)
    db.restore(str(tmp_path / "copy"))
    assert seen(db.current("c")) == before
    db.put("c", docs(spark, a={"n": 9}))
    assert db.one("c", "a").version_vector == {"local": 5}


def test_compaction_in_the_background(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), settings=Settings(replication_factor=1, write_quorum=1, read_quorum=1, compaction_seconds=1, l0_file_num_threshold=2))
    for i in range(2):
        db.put("c", docs(spark, a={"n": i}))
    stop = db.keep_compacted()
    for _ in range(60):
        if len(db.segments()) == 1:
            break
        time.sleep(0.5)
    stop.set()
    assert len(db.segments()) == 1 and seen(db.current("c")) == {"a": {"n": 1}}


def test_writes_are_whole_or_not_there(spark, db):
    db.put("c", docs(spark, a={"n": 1}))
    broken = docs(spark, b={"n": 2}).withColumn("data", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception):
        db.put("c", broken)
    assert len(db.segments()) == 1 and seen(db.current("c")) == {"a": {"n": 1}}


def test_rows_of_one_id(spark, db):
    twice = spark.createDataFrame([("a", '{"n":1}'), ("a", '{"n":2}')], "id string, data string")
    for _ in range(2):
        db.put("c", twice)
    assert seen(db.current("c")) == {"a": {"n": 2}} and db.log("c").count() == 2
    numbers = [r.seq for r in db.log("c").select("seq").distinct().collect()]
    assert len(numbers) == 2


def test_equal_timestamps_go_by_the_order_of_writes(spark, db):
    for n in (3, 1, 2):
        db.put("c", docs(spark, a={"n": n}), timestamp=5.0)
    assert seen(db.current("c")) == {"a": {"n": 2}}


def test_raw_put_of_many_collections(spark, db):
    n = 10_001
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.format_string("c%05d", "id").alias("collection"), F.parse_json(F.lit("{}")).alias("data"), F.create_map(F.lit("x"), F.lit(1).cast("bigint")).alias("version_vector"), F.lit(1.0).alias("timestamp"))
    db.raw_put(rows)
    assert db.collections() == [f"c{i:05d}" for i in range(n)]
    assert seen(db.get("c10000", "10000")) == {"10000": {}}
    with pytest.raises(Exception, match="not a collection name"):
        db.raw_put(rows.limit(1).withColumn("collection", F.lit("a:b")))


def test_names_of_collections(spark, db):
    for name in ("a/b", "100%", "007", "é ü"):
        db.put(name, docs(spark, x={"n": name}))
    assert db.collections() == sorted(["a/b", "100%", "007", "é ü"])
    db.drop("a/b")
    assert seen(db.current("007")) == {"x": {"n": "007"}} and "a/b" not in db.collections()


def test_members(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), settings=Settings(nodes=tuple((f"n{i}", "localhost", i) for i in range(4))))
    many = docs(spark, **{f"k{i}": {"n": i} for i in range(40)})
    db.put("c", many)

    def held():
        return {(r.id, r.node) for r in db.copies("c").select("id", "node").collect()}

    def owned():
        return {(f"k{i}", n) for i in range(40) for n in db.ring.replicas_of(f"k{i}")}

    assert held() == owned() and db.one("c", "k3").replicas_read == 3
    db.add_node("n9", "localhost", 9)
    assert owned() <= held() and any(n == "n9" for _, n in owned())
    db.remove_node("n1")
    assert owned() <= held() and all(n != "n1" for _, n in held())
    before = len(db.segments())
    db.repair()
    assert db.log().count() == db._read(db.segments()[:before]).count()


def test_copies_that_differ(spark, tmp_path):
    settings, path = Settings(nodes=tuple((f"n{i}", "localhost", i) for i in range(3))), str(tmp_path / "db")
    whole = Database(spark, path, settings=settings)
    whole.put("c", docs(spark, a={"n": 1}), timestamp=1.0)
    two = whole.ring.replicas_of("a")[1:]
    Database(spark, path, settings=settings, node=two[0], live=two).put("c", docs(spark, a={"n": 2}), timestamp=2.0)
    lone = whole.ring.replicas_of("a")[:1]
    Database(spark, path, settings=settings, node=lone[0], live=lone).put("c", docs(spark, a={"n": 3}), w=1, timestamp=1.5)
    assert json.loads(whole.one("c", "a").data) == {"n": 2} and whole.one("c", "a").replicas_read == 3
    vectors = {r.node: r.version_vector for r in whole.copies("c").collect()}
    ahead = {n: {k for k in v if v[k] > vectors[lone[0]].get(k, 0)} for n, v in vectors.items()}
    want = {(lone[0], n) for n in two if ahead[n] and any(v > vectors[n].get(k, 0) for k, v in vectors[lone[0]].items())}
    assert {(r.node_a, r.node_b) for r in whole.conflicts("c").collect()} == want and want
    whole.repair()
    assert {r.timestamp for r in whole.copies("c").collect()} == {2.0} and whole.conflicts("c").count() == 0


def test_writes_replay_only_what_they_touch(spark, db):
    db.put("c", docs(spark, **{f"k{i}": {"n": i} for i in range(50)}))
    known = db._known("c", docs(spark, k1={}, other={}))
    assert [r.id for r in known.collect()] == ["k1"]
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi")


def test_raw_put_keeps_the_newest(spark, db):
    def row(n, when):
        return spark.createDataFrame([("k", "c", json.dumps({"n": n}), {"x": n}, when)], "id string, collection string, data string, version_vector map<string,bigint>, timestamp double").withColumn("data", F.parse_json("data"))

    db.raw_put(row(2, 20.0))
    db.raw_put(row(1, 10.0))
    assert seen(db.current("c")) == {"k": {"n": 2}}


def test_quorum(spark, tmp_path):
    ring = Ring.of("a", "b", "c")
    down = Database(spark, str(tmp_path / "q"), ring, "a", live=["a"])
    with pytest.raises(RuntimeError):
        down.put("c", docs(spark, x={}), w=2)
    with pytest.raises(ValueError):
        down.put("c", docs(spark, x={}), w=4)
    with pytest.raises(RuntimeError):
        down.put("c", docs(spark, x={}))
    down.put("c", docs(spark, x={}), w=1)
    assert down.current("c").count() == 1 and down.get("c", "x", r=1).count() == 1
    with pytest.raises(RuntimeError):
        down.get("c", "x", r=2)


def test_settings():
    config = {"replication_factor": 2, "nodes": {"node1": {"host": "localhost", "port": 8081}, "node2": {"port": 8082}, "node3": {"port": 8083}}}
    ring = Settings.of(config).ring("node1")
    assert ring.replication == 2 and ring.address("node2") == "http://localhost:8082" and len(ring.replicas_of("k")) == 2
    for bad in ({"w": 1}, {"replication_factor": 1}, {"query_limit": -1}, {"read_quorum": 4}):
        with pytest.raises(ValueError):
            Settings.of(bad)


def test_settings_files(spark, tmp_path):
    config = {"cluster": {"replication_factor": 3}, "nodes": {f"node{i}": {"host": "127.0.0.1", "port": 8080 + i, "data_dir": "./data"} for i in (1, 2, 3)}}
    (tmp_path / "c.json").write_text(json.dumps(config))
    (tmp_path / "c.yaml").write_text("cluster:\n  replication_factor: 3\nnodes:\n" + "".join(f"  node{i}:\n    host: 127.0.0.1\n    port: {8080 + i}\n" for i in (1, 2, 3)))
    pytest.importorskip("yaml")
    read = Settings.read(str(tmp_path / "c.json"))
    assert read == Settings.read(str(tmp_path / "c.yaml")) == Settings.of(config)
    db = Database(spark, str(tmp_path / "db"), settings=read)
    assert db.ring.nodes == ("node1", "node2", "node3") and db.ring.address("node2") == "http://127.0.0.1:8082"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "docs.jsonl"
    path.write_text('{"_id":"u1","age":30}\n\n{"_id":"u2","age":"30"}\nnot json\n')
    got = tables.read_json_lines(spark, str(path), "users")
    assert got.count() == 3 and {r.id for r in got.collect()} == {"u1", "u2", None}


def test_write_sorted(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as k")
    tables.write_sorted(df, str(tmp_path / "t"), "k", 4)
    assert spark.read.parquet(str(tmp_path / "t")).where("k = '77'").count() == 1
