import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import keys, versions
from docengine.operators import filters, modeling, oplog, query, replicas
from docengine.operators.ring import Ring, missing_copies, token

VALUES = [30, "30", 30.0, 29.5, True, False, 1, 0, None, [30], [1, "a", None], "abc", 10**25, -3, 1e300, 2**53 + 1]


def python_rule(value, op, wanted):
    """The comparison rules in plain Python."""
    if wanted is None:
        return op == "$eq" and value is None
    kind = lambda x: bool if isinstance(x, bool) else float if isinstance(x, (int, float)) else type(x)
    if kind(value) is not kind(wanted):
        return False
    if op == "$eq":
        return type(value) is list and len(value) == len(wanted) and all(python_rule(a, "$eq", b) for a, b in zip(value, wanted)) if isinstance(value, list) else value == wanted
    if isinstance(value, list):
        return False
    return {"$gt": value > wanted, "$gte": value >= wanted, "$lt": value < wanted, "$lte": value <= wanted}[op]


def test_variant_filters(spark):
    import json

    rows = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(VALUES)] + [(99, "{}")], "id int, t string").select("id", F.parse_json("t").alias("data")).cache()
    specs = [(op, w) for w in VALUES for op in filters.OPERATORS]
    marks = [F.when(filters.compile_variant_filter({"x": {op: w}}, F.col("data")), F.lit(k)) for k, (op, w) in enumerate(specs)]
    for r in rows.select("id", F.array_compact(F.array(*marks)).alias("hits")).collect():
        value = None if r.id == 99 else VALUES[r.id]
        want = [k for k, (op, w) in enumerate(specs) if python_rule(value, op, w)]
        assert r.hits == want, (value, [specs[k] for k in set(r.hits) ^ set(want)])
    rows.unpersist()


@pytest.mark.parametrize("kind,values", [("bigint", [30, 29, None, -1, 2**53 + 1]), ("double", [30.0, 29.5, None, float("nan")]), ("string", ["30", "abc", None]), ("boolean", [True, False, None]), ("array<bigint>", [[30], [], None]), ("decimal(10,2)", [None])])
def test_typed_filters(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, x {kind}")
    for wanted in [30, 30.0, 29.5, "30", True, None, [30], 2.0**53]:
        for op in filters.OPERATORS:
            got = {r.id for r in df.filter(filters.compile_filter({"x": {op: wanted}}, df.schema)).collect()}
            want = {i for i, v in enumerate(values) if python_rule(v, op, wanted)}
            assert got == want, (kind, op, wanted)


def test_filter_names_and_errors(spark):
    df = spark.createDataFrame([(1, {"id": "u1"}, "u2", {"size": "xl"})], "_id int, user struct<id:string>, `user.id` string, attributes map<string,string>")
    assert df.filter(filters.compile_filter({"user.id": "u2"}, df.schema)).count() == 1
    assert df.filter(filters.compile_filter({"attributes.size": "xl"}, df.schema)).count() == 1
    nested = df.select("_id", "user", "attributes")
    assert nested.filter(filters.compile_filter({"user.id": "u1"}, nested.schema)).count() == 1
    assert df.filter(filters.compile_filter({"USER.ID": "u2"}, df.schema)).count() == 0
    for bad in ({"a": {"$regex": "x"}}, {"a": {}}, {"a": {"$gt": {"b": 1}}}, [], {"a": object()}):
        with pytest.raises(filters.FilterError):
            filters.compile_filter(bad, T.StructType([T.StructField("a", T.IntegerType())]))
    assert df.filter(filters.compile_filter({"_id": True}, df.schema, python_bool_eq=True)).count() == 1
    assert df.filter(filters.compile_filter({"_id": True}, df.schema)).count() == 0


def test_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = df.filter(filters.compile_filter({"o_orderstatus": "P", "o_totalprice": {"$gte": 1000}}, df.schema)).select("o_orderkey")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1000" in plan and "(o_orderstatus" in plan.split("PushedFilters")[1]
    assert "o_custkey" not in plan.split("ReadSchema")[1]
    page = query.run(df, {"sort": {"o_totalprice": -1}, "limit": 10, "offset": 5}, "o_orderkey")
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 3 or None) for i in range(23)], "id int, k int")
    whole = [r.id for r in query.run(df, {"sort": {"k": -1}}, "id").collect()]
    parts = [r.id for o in range(0, 30, 7) for r in query.run(df, {"sort": {"k": -1}, "limit": 7, "offset": o}, "id").collect()]
    assert whole == parts and whole[-1] == 21
    assert query.run(df, {"limit": 0}, "id").count() == 0 and query.run(df, {"offset": 50}, "id").count() == 0
    for bad in ({"limit": -1}, {"offset": -1}, {"limit": True}, {"limit": "5"}, {"sort": {"k": 2}}, {"filter": {"k": {"$x": 1}}}, []):
        with pytest.raises(ValueError):
            query.run(df, bad, "id")


def test_conjunction_is_two_filters(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = {"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 100000}}
    both = df.filter(filters.compile_filter(a | b, df.schema))
    one = df.filter(filters.compile_filter(a, df.schema))
    assert sorted(both.collect()) == sorted(one.filter(filters.compile_filter(b, df.schema)).collect())


def test_vectors(spark):
    cases = [({}, {}, "equal"), ({"a": 0}, {}, "equal"), ({"a": 1}, {"a": 1, "b": 0}, "equal"), ({"a": 1}, {"a": 2}, "before"), ({"a": 1, "b": 1}, {"a": 1}, "after"), ({"a": 1}, {"b": 1}, "conflict"), (None, {"a": 1}, "before")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a map<string,bigint>, b map<string,bigint>")
    for r in df.select("i", versions.compare(F.col("a"), F.col("b")).alias("how"), versions.increment(F.col("a"), F.lit("a")).alias("up"), versions.merge(F.col("a"), F.col("b")).alias("both")).collect():
        a, b, how = cases[r.i]
        assert r.how == how
        assert r.up == {**(a or {}), "a": (a or {}).get("a", 0) + 1}
        assert r.both == {k: max((a or {}).get(k, 0), (b or {}).get(k, 0)) for k in {**(a or {}), **b}}
    assert versions.strong(2, 2, 3) and not versions.strong(1, 2, 3)
    for bad in (0, 4, True, "2"):
        with pytest.raises(ValueError):
            versions.check_quorum(bad, 3)


def plain_replicas(ring, key):
    tokens = sorted((token(f"{n}:{i}"), n) for n in ring.nodes for i in range(100))
    h, out = token(key), []
    for _, n in [t for t in tokens if t[0] > h] + [t for t in tokens if t[0] <= h]:
        if n not in out:
            out.append(n)
    return out[: ring.replication]


def test_ring(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**9)) for _ in range(400)] + ["", "é", "a:b"]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    for n in (0, 1, 2, 3, 5, 9):
        ring = Ring.of(*(f"node{i}" for i in range(n)))
        got = {r.k: r.replicas for r in ring.place(df, F.col("k")).collect()}
        assert got == {w: plain_replicas(ring, w) for w in words}
    assert ring.replicas_of("é") == plain_replicas(ring, "é")
    assert ring.add("x").remove("x") == ring
    with pytest.raises(ValueError):
        ring.add("node1")
    with pytest.raises(ValueError):
        ring.remove("nobody")
    with pytest.raises(ValueError):
        Ring.of("a", "b", local="a").remove("a")
    assert Ring.of("a", addresses={"a": ("localhost", 8081)}).address("a") == "http://localhost:8081"
    with pytest.raises(ValueError):
        Ring.of("a").address("b")


def test_missing_copies(spark):
    ring = Ring.of("a", "b", "c", "d")
    held = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "d")], "k string, node string")
    got = {(r.k, r.node) for r in missing_copies(ring, held, "k", "node").collect()}
    assert got == {(k, n) for k in ("k1", "k2") for n in plain_replicas(ring, k)} - {("k1", "a"), ("k1", "b"), ("k2", "d")}


def test_newest_copy_and_quorums(spark):
    rows = [("k", "n0", 0, 5.0), ("k", "n1", 1, 7.0), ("k", "n2", 2, 7.0), ("one", "n1", 1, 1.0)]
    copies = spark.createDataFrame(rows, "k string, node string, replica_pos int, timestamp double")
    assert {(r.k, r.node) for r in replicas.newest(copies, ["k"]).collect()} == {("k", "n1"), ("one", "n1")}
    assert [(r.k, r.node, r.replicas_read) for r in replicas.read(copies, ["k"], ["n0", "n2"], 2).collect()] == [("k", "n2", 2)]
    assert replicas.read(copies, ["k"], [], 1).count() == 0
    with pytest.raises(ValueError):
        replicas.read(copies, ["k"], ["n0"], 0)
    ring = Ring.of("a", "b")
    written = replicas.write(ring, spark.createDataFrame([("x",)], "k string"), "k", ["a"], 2).first()
    assert (written.acks, written.success) == (1, False)


def test_log_against_a_dictionary(spark):
    rng = random.Random(4)
    state, rows = {}, []
    for seq in range(400):
        key, when = f"k{rng.randrange(25)}", float(seq // 3)
        if rng.random() < 0.3:
            state.pop(key, None)
            rows.append((seq, "delete", "c", key, None, when))
        else:
            state[key] = seq
            rows.append((seq, "put", "c", key, seq, when))
    ops = spark.createDataFrame(rows, "seq long, op string, collection string, id string, data long, timestamp double")
    want = sorted(state.items())
    assert sorted((r.id, r.data) for r in oplog.replay(ops).collect()) == want
    for cut in (0, 150, 400):
        mixed = oplog.compact(ops.where(F.col("seq") < cut), 3).unionByName(ops.where(F.col("seq") >= cut))
        assert sorted((r.id, r.data) for r in oplog.replay(mixed).collect()) == want
    assert oplog.compact(ops, keep_deletes=False).count() == len(want)


def test_compaction_plan(spark):
    def plan(files):
        return sorted(tuple(r) for r in oplog.compaction_plan(spark.createDataFrame(files, "name string, size long")).select("name", "to_level").collect())

    mb = 1 << 20
    assert plan([(f"L0_{i}.sst", mb) for i in range(3)]) == []
    assert plan([("x/L1_1.sst", 6 * mb), ("x/L1_2.sst", 6 * mb), ("x/L2_1.sst", mb), ("x/L3_1.sst", mb)]) == [("x/L1_1.sst", 2), ("x/L2_1.sst", 2)]
    assert plan([("note.txt", mb)]) == []


def test_keys(spark):
    df = spark.createDataFrame([("c", "a:b"), ("c", ""), ("é", "ü:")], "c string, i string")
    made = df.select("c", "i", keys.encode_key(F.col("c"), F.col("i")).alias("k"))
    for r in made.select("c", "i", keys.collection_of(F.col("k")).alias("c2"), keys.id_of(F.col("k")).alias("i2"), keys.from_hex(keys.to_hex(F.col("k"))).alias("k2"), "k").collect():
        assert (r.c, r.i, bytes(r.k)) == (r.c2, r.i2, bytes(r.k2)) and bytes(r.k) == f"{r.c}:{r.i}".encode()
    bad = spark.createDataFrame([(bytearray(b"\xff\xfe:x"),), (bytearray(b"nocolon"),)], "k binary")
    assert [r[0] for r in bad.select(keys.collection_of(F.col("k"))).collect()] == [None, None]
    assert spark.range(1).select(keys.from_hex(F.lit("abc")), keys.from_hex(F.lit("zz"))).first()[:] == (None, None)
    with pytest.raises(ValueError):
        keys.check_collection("a:b")


def test_shapes(spark):
    docs = spark.createDataFrame([(1, "p1"), (2, None)], "id int, ref string")
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "of int, n int, v string")
    got = modeling.embed(docs, "id", parts, "of", ["v"], "parts", ["n"])
    assert {r.id: [x.v for x in r.parts] for r in got.collect()} == {1: ["a", "b"], 2: []}
    assert modeling.unwind(got, "parts", ["id"]).count() == 2 and modeling.unwind(got, "parts", ["id"], outer=True).count() == 3
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "y")], "id string, parent string")
    assert sorted(tuple(r) for r in modeling.tree(nodes, "id", "parent", "id").collect()) == [("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c")]
    nested = spark.createDataFrame([((1, 2), 3)], "s struct<a:int,b:int>, c int")
    assert query.without(nested, ["s.a", "c"]).first().asDict(True) == {"s": {"b": 2}}
