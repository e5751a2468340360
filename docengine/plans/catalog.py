"""The query catalogue: one query per operator over the test tables, with the SQL that it must agree with."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import keys, versions
from docengine.operators import filters, modeling, oplog, query, replicas
from docengine.operators.ring import Ring, balance, drops, migration_plan, missing_copies, primary
from docengine.sources import scratch, tables
from docengine.sources.database import Database
from docengine.sources.settings import Settings
from docengine.sources.tables import read_table
from docengine.streaming import latest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
FIVE = Ring.of("node1", "node2", "node3", "node4", "node5")
SIX = FIVE.add("node6")
LIVE = ("node1", "node3", "node4")


def entry(name: str, sql: str):
    def register(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders")


def _picked(df: DataFrame, spec: dict, fields=ORDER_FIELDS, **options) -> DataFrame:
    return df.filter(filters.compile_filter(spec, df.schema, **options)).select(*fields)


# --- filters ---

_O = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE "


def _filter(name: str, spec: dict, where: str) -> None:
    QUERIES[name] = lambda spark, d: _picked(orders(spark, d), spec)
    ORACLES[name] = _O + where


_filter("filter_eq", {"o_orderstatus": "P"}, "o_orderstatus IS NOT DISTINCT FROM 'P'")
_filter("filter_explicit_eq", {"o_custkey": {"$eq": 7}}, "o_custkey = 7")
_filter("filter_gt", {"o_totalprice": {"$gt": 400000}}, "o_totalprice > 400000")
_filter("filter_gte", {"o_orderkey": {"$gte": 9000}}, "o_orderkey >= 9000")
_filter("filter_lt", {"o_totalprice": {"$lt": 2000.5}}, "o_totalprice < 2000.5")
_filter("filter_lte", {"o_orderkey": {"$lte": 50}}, "o_orderkey <= 50")
_filter("filter_range", {"o_totalprice": {"$gte": 1000, "$lt": 5000}}, "o_totalprice >= 1000 AND o_totalprice < 5000")
_filter("filter_conj", {"o_orderstatus": "F", "o_totalprice": {"$gt": 300000}, "o_custkey": {"$lte": 500}}, "o_orderstatus = 'F' AND o_totalprice > 300000 AND o_custkey <= 500")
_filter("filter_class_mismatch", {"o_orderkey": {"$gt": "30"}}, "false")
_filter("filter_missing_field", {"no_such_field": None, "o_custkey": 3}, "o_custkey = 3")
_filter("filter_empty", {}, "true")
_filter("filter_fraction_on_whole", {"o_custkey": {"$gt": 1.5, "$lte": 4.0}}, "o_custkey >= 2 AND o_custkey <= 4")

_NULLED = "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders"


@entry("filter_null", f"SELECT o_orderkey FROM ({_NULLED}) WHERE status IS NULL")
def filter_null(spark: SparkSession, d: str) -> DataFrame:
    docs = orders(spark, d).select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))
    return _picked(docs, {"status": None}, ["o_orderkey"])


#: Documents on which the comparison rules differ (fixed values).
STRICT = ('{"x":30}', '{"x":"30"}', '{"x":30.0}', '{"x":29.5}', '{"x":true}', '{"x":1}', '{"x":0}', '{"x":null}', '{}', '{"x":[30]}', '{"x":{"a":30}}', '{"x":"abc"}', '{"x":1e30}', '{"x":[1,"a",null]}', '{"x":false}')
NESTED = ('{"user":{"id":"u1"}}', '{"user.id":"u1"}', '{"user":{"id":"u2"}}', '{"user":"u1"}', '{"user":{"id":null}}', '{"user":{"name":"u1"},"user.id":"u2"}')


def _json_docs(spark: SparkSession, texts) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return rows.select("id", F.parse_json("text").alias("data"))


def _values(texts) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}'::JSON)" for i, t in enumerate(texts)) + ") AS t(id, j)"


_NUM = "json_type(j, '$.x') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT')"
_DBL = f"CASE WHEN {_NUM} THEN CAST(json_extract_string(j, '$.x') AS DOUBLE) END"
_STR = "CASE WHEN json_type(j, '$.x') = 'VARCHAR' THEN json_extract_string(j, '$.x') END"
STRICT_RULES = (
    ("eq 30", {"x": 30}, f"{_DBL} = 30"),
    ("eq 30.0", {"x": 30.0}, f"{_DBL} = 30"),
    ("gt 29", {"x": {"$gt": 29}}, f"{_DBL} > 29"),
    ("gte 29.5", {"x": {"$gte": 29.5}}, f"{_DBL} >= 29.5"),
    ("lt 1", {"x": {"$lt": 1}}, f"{_DBL} < 1"),
    ("range", {"x": {"$gt": 0, "$lte": 30}}, f"{_DBL} > 0 AND {_DBL} <= 30"),
    ("eq '30'", {"x": "30"}, f"{_STR} = '30'"),
    ("gt 'a'", {"x": {"$gt": "a"}}, f"{_STR} > 'a'"),
    ("eq true", {"x": True}, "json_type(j, '$.x') = 'BOOLEAN' AND json_extract_string(j, '$.x') = 'true'"),
    ("eq null", {"x": None}, "json_type(j, '$.x') IS NULL OR json_type(j, '$.x') = 'NULL'"),
    ("gt null", {"x": {"$gt": None}}, "false"),
    ("eq list", {"x": [30]}, "json_type(j, '$.x') = 'ARRAY' AND CAST(json_extract(j, '$.x') AS VARCHAR) = '[30]'"),
    ("eq mixed list", {"x": [1, "a", None]}, """json_type(j, '$.x') = 'ARRAY' AND CAST(json_extract(j, '$.x') AS VARCHAR) = '[1,"a",null]'"""),
)


@entry("filter_type_strict", " UNION ALL ".join(f"SELECT '{n.replace(chr(39), chr(39) * 2)}' AS rule, CAST(id AS BIGINT) AS id FROM {_values(STRICT)} WHERE {w}" for n, _, w in STRICT_RULES))
def filter_type_strict(spark: SparkSession, d: str) -> DataFrame:
    docs = _json_docs(spark, STRICT)
    rules = [F.when(filters.compile_variant_filter(spec, F.col("data")), F.lit(name)) for name, spec, _ in STRICT_RULES]
    return docs.select("id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


@entry("filter_dotted_json", f"""SELECT CAST(id AS BIGINT) AS id FROM {_values(NESTED)} WHERE coalesce(json_extract_string(j, '$."user.id"'), json_extract_string(j, '$.user.id')) = 'u1'""")
def filter_dotted_json(spark: SparkSession, d: str) -> DataFrame:
    return _json_docs(spark, NESTED).filter(filters.compile_variant_filter({"user.id": "u1"}, F.col("data"))).select("id")


@entry("filter_dotted", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90")
def filter_dotted(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "events").select("event_id", "user_id", F.parse_json(F.concat(F.lit('{"props":'), "props", F.lit("}"))).alias("data"))
    return docs.filter(filters.compile_variant_filter({"props.k": {"$gt": 90}}, F.col("data"))).select("event_id", "user_id")


@entry("filter_dotted_struct", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 20")
def filter_dotted_struct(spark: SparkSession, d: str) -> DataFrame:
    docs = modeling.snapshot(orders(spark, d), "o_custkey", read_table(spark, d, "customer"), "c_custkey", ["c_mktsegment", "c_nationkey"], "user")
    return _picked(docs, {"user.c_mktsegment": "BUILDING", "user.c_nationkey": {"$gte": 20}}, ["o_orderkey"])


_ITEMS = "SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey"


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))


@entry("filter_list_eq", f"SELECT l_orderkey FROM ({_ITEMS}) WHERE flags = ['A', 'N']")
def filter_list_eq(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_flags(spark, d), {"flags": ["A", "N"]}, ["l_orderkey"])


@entry("array_contains", f"SELECT l_orderkey FROM ({_ITEMS}) WHERE list_contains(flags, 'R')")
def array_contains(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_flags(spark, d), {"flags": "R"}, ["l_orderkey"], contains=True)


@entry("owner_scope", _O + "o_custkey = 11 AND o_totalprice > 100000")
def owner_scope(spark: SparkSession, d: str) -> DataFrame:
    return _picked(filters.scoped(orders(spark, d), "o_custkey", 11), {"o_totalprice": {"$gt": 100000}})


@entry("collection_prefix", "SELECT lower(hex('orders:' || o_orderkey)) AS raw FROM orders")
def collection_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the collection orders, found by their prefix among all keys of two collections."""
    mine = orders(spark, d).select(keys.encode_key(F.lit("orders"), F.col("o_orderkey").cast("string")).alias("key"))
    others = read_table(spark, d, "customer").select(keys.encode_key(F.lit("customer"), F.col("c_custkey").cast("string")).alias("key"))
    return mine.union(others).where(keys.in_collection(F.col("key"), "orders")).select(keys.to_hex(F.col("key")).alias("raw"))


# --- sort, paging, projection ---


@entry("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sort_limit_offset(spark: SparkSession, d: str) -> DataFrame:
    body = {"filter": {"o_orderstatus": "P"}, "sort": {"o_totalprice": -1}, "limit": 10, "offset": 5, "fields": ["o_orderkey", "o_totalprice"]}
    return query.run(orders(spark, d), body, "o_orderkey")


@entry("sort_two_keys", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders ORDER BY o_orderstatus DESC, o_custkey ASC, o_orderkey LIMIT 100")
def sort_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return query.run(orders(spark, d), {"sort": {"o_orderstatus": -1, "o_custkey": 1}, "fields": ["o_orderkey", "o_orderstatus", "o_custkey"]}, "o_orderkey")


@entry("sort_nulls", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS part FROM orders ORDER BY part ASC NULLS FIRST, o_orderkey LIMIT 30")
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    docs = orders(spark, d).select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("part"))
    return query.run(docs, {"sort": {"part": 1}, "limit": 30}, "o_orderkey")


@entry("page_default", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def page_default(spark: SparkSession, d: str) -> DataFrame:
    return query.run(read_table(spark, d, "customer"), {"fields": ["c_custkey", "c_name"]}, "c_custkey")


@entry("collection_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def collection_page(spark: SparkSession, d: str) -> DataFrame:
    return query.run(read_table(spark, d, "customer"), {"limit": 20, "offset": 40, "fields": ["c_custkey", "c_name"]}, "c_custkey")


@entry("page_count", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 90)")
def page_count(spark: SparkSession, d: str) -> DataFrame:
    return query.run(read_table(spark, d, "customer"), {"limit": 20, "offset": 90}, "c_custkey").agg(F.count(F.lit(1)).alias("n"))


@entry("project_fields", "SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS nothing FROM part")
def project_fields(spark: SparkSession, d: str) -> DataFrame:
    return query.project(read_table(spark, d, "part"), ["p_partkey", "p_name", "nothing"])


@entry("redact_fields", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def redact_fields(spark: SparkSession, d: str) -> DataFrame:
    return query.without(read_table(spark, d, "supplier"), ["s_acctbal"])


@entry("point_get", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return _picked(orders(spark, d), {"o_orderkey": 77})


# --- envelope, keys, listings ---


@entry("envelope", "SELECT CAST(event_id AS VARCHAR) AS id, 'events' AS collection, event_type, 'node1=1' AS vector, epoch_us(ts) / 1e6 AS timestamp FROM events")
def envelope(spark: SparkSession, d: str) -> DataFrame:
    held = query.envelope(read_table(spark, d, "events"), "events", "event_id", keys.epoch_seconds(F.col("ts")), "node1")
    return held.select("id", "collection", "data.event_type", versions.as_text(F.col("version_vector")).alias("vector"), "timestamp")


@entry("list_collections", " UNION ALL ".join(f"SELECT '{t}' AS collection FROM (SELECT 1 FROM {t} LIMIT 1)" for t in tables.TABLES))
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return tables.collections(((t, read_table(spark, d, t)) for t in tables.TABLES), spark)


_KEYS = "SELECT 'orders:' || o_orderstatus || ':' || o_orderkey AS k FROM orders"


@entry("key_codec", f"SELECT k, lower(hex(k)) AS raw, split_part(k, ':', 1) AS collection, substr(k, strpos(k, ':') + 1) AS id FROM ({_KEYS})")
def key_codec(spark: SparkSession, d: str) -> DataFrame:
    key = keys.encode_key(F.lit("orders"), F.concat_ws(":", "o_orderstatus", F.col("o_orderkey").cast("string")))
    made = orders(spark, d).select(key.alias("key"))
    back = made.select("key", keys.to_hex(F.col("key")).alias("raw")).withColumn("again", keys.from_hex(F.col("raw")))
    return back.select(F.col("again").cast("string").alias("k"), "raw", keys.collection_of(F.col("again")).alias("collection"), keys.id_of(F.col("again")).alias("id"))


@entry("distinct_keys", "SELECT DISTINCT 'c' || c_nationkey AS k FROM customer UNION SELECT DISTINCT 'c' || s_nationkey FROM supplier")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("k"))
    b = read_table(spark, d, "supplier").select(F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("k"))
    return a.unionByName(b).distinct()


# --- log of operations ---


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations on users: an error deletes, anything else puts."""
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.PUT).alias("op"),
        F.lit("users").alias("collection"),
        F.col("user_id").cast("string").alias("id"),
        F.struct("event_type", "value").alias("data"),
        F.create_map(F.lit("n1"), F.col("event_id")).alias("version_vector"),
        keys.epoch_seconds(F.col("ts")).alias("timestamp"),
    )


_LATEST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events"
_VISIBLE = f"SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type FROM ({_LATEST}) WHERE rn = 1 AND event_type <> 'error'"


def _seen(state: DataFrame) -> DataFrame:
    return state.select("id", "seq", F.col("data.event_type").alias("event_type"))


@entry("oplog_latest", _VISIBLE)
def oplog_latest(spark: SparkSession, d: str) -> DataFrame:
    return _seen(oplog.replay(event_log(spark, d)))


@entry("oplog_deleted", f"SELECT CAST(user_id AS VARCHAR) AS id FROM ({_LATEST}) WHERE rn = 1 AND event_type = 'error'")
def oplog_deleted(spark: SparkSession, d: str) -> DataFrame:
    return oplog.newest(event_log(spark, d)).where(F.col("op") == oplog.DELETE).select("id")


@entry("compact_equiv", _VISIBLE)
def compact_equiv(spark: SparkSession, d: str) -> DataFrame:
    ops = event_log(spark, d)
    old = oplog.compact(ops.where("seq % 3 <> 0"), files=2)
    return _seen(oplog.replay(old.unionByName(ops.where("seq % 3 = 0"))))


@entry("oplog_batch", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE WHEN o_orderkey % 4 = 1 THEN 2 ELSE 1 END AS BIGINT) AS seq FROM orders WHERE o_orderkey % 4 <> 0")
def oplog_batch(spark: SparkSession, d: str) -> DataFrame:
    docs = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("id"), F.lit("orders").alias("collection"), F.struct("o_totalprice").alias("data"), F.create_map(F.lit("n"), F.lit(1).cast("bigint")).alias("version_vector"), F.lit(1.0).alias("timestamp"))
    key = F.col("id").cast("bigint") % 4
    batch = oplog.operations(docs, oplog.PUT, F.lit(1)).unionByName(oplog.operations(docs.where(key == 0), oplog.DELETE, F.lit(2))).unionByName(oplog.operations(docs.where(key == 1), oplog.PUT, F.lit(2)))
    return oplog.replay(batch).select("id", "seq")


@entry("drop_collection", "SELECT 'customer' AS collection, count(*) AS n FROM customer")
def drop_collection(spark: SparkSession, d: str) -> DataFrame:
    def ops(table: str, key: str) -> DataFrame:
        return read_table(spark, d, table).select(F.lit(1).alias("seq"), F.lit(oplog.PUT).alias("op"), F.lit(table).alias("collection"), F.col(key).cast("string").alias("id"), F.lit(1.0).alias("timestamp"))

    both = ops("customer", "c_custkey").union(ops("supplier", "s_suppkey"))
    return oplog.replay(oplog.drop_collection(both, "supplier")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


@entry("compaction_plan", "SELECT * FROM (VALUES ('data/L0_1.sst', 1), ('data/L0_2.sst', 1), ('data/L0_3.sst', 1), ('data/L0_10.sst', 1)) AS t(name, to_level)")
def compaction_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f"data/L0_{i}.sst", 5 << 20) for i in (1, 2, 3, 10)] + [("data/L1_4.sst", 30 << 20), ("data/wal.log", 1)]
    return oplog.compaction_plan(spark.createDataFrame(rows, "name string, size long")).select("name", "to_level")


@entry("cas_update", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 5 = c_custkey % 4 AS accepted FROM customer")
def cas_update(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "customer").select(F.lit("c").alias("collection"), F.col("c_custkey").cast("string").alias("id"), "c_custkey")
    state = docs.select("collection", "id", F.create_map(F.lit("n1"), F.col("c_custkey") % 5).alias("version_vector"))
    updates = docs.select("collection", "id", F.create_map(F.lit("n1"), F.col("c_custkey") % 4, F.lit("n2"), F.lit(0).cast("bigint")).alias("expected"))
    return oplog.compare_and_set(state, updates).select("id", "accepted")


# --- versions and copies ---


def _vector(a: Column, b: Column) -> Column:
    return F.create_map(F.lit("a"), a.cast("bigint"), F.lit("b"), b.cast("bigint"))


@entry("version_increment", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'a=1,b=' || c_custkey % 2 ELSE 'a=' || (c_custkey % 3 + 1) || ',b=' || c_custkey % 2 END AS vector FROM customer")
def version_increment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    own = F.when(k % 7 == 0, F.create_map(F.lit("b"), k % 2)).otherwise(_vector(k % 3, k % 2))
    return read_table(spark, d, "customer").select("c_custkey", versions.as_text(versions.increment(own, F.lit("a"))).alias("vector"))


_AB = "c_custkey % 3 AS a1, c_custkey % 2 AS b1, c_custkey % 4 AS a2, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS b2"


@entry("version_compare", f"SELECT c_custkey, CASE WHEN a1 = a2 AND b1 = b2 THEN 'equal' WHEN a1 <= a2 AND b1 <= b2 THEN 'before' WHEN a1 >= a2 AND b1 >= b2 THEN 'after' ELSE 'conflict' END AS how FROM (SELECT c_custkey, {_AB} FROM customer)")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    right = F.when(k % 5 == 0, F.create_map(F.lit("a"), k % 4)).otherwise(_vector(k % 4, F.lit(1)))
    return read_table(spark, d, "customer").select("c_custkey", versions.compare(_vector(k % 3, k % 2), right).alias("how"))


@entry("version_merge", f"SELECT c_custkey, 'a=' || greatest(a1, a2) || ',b=' || greatest(b1, b2) AS vector FROM (SELECT c_custkey, {_AB} FROM customer)")
def version_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    right = F.when(k % 5 == 0, F.create_map(F.lit("a"), k % 4)).otherwise(_vector(k % 4, F.lit(1)))
    return read_table(spark, d, "customer").select("c_custkey", versions.as_text(versions.merge(_vector(k % 3, k % 2), right)).alias("vector"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    k, pos = F.col("o_orderkey"), F.col("replica_pos")
    each = orders(spark, d).select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("replica_pos"))
    vector = F.when(pos == 0, _vector(k % 3, k % 2)).when(pos == 1, _vector(k % 2, k % 3)).otherwise(F.create_map(F.lit("a"), F.lit(1).cast("bigint")))
    return each.select("o_orderkey", "replica_pos", F.concat(F.lit("n"), pos.cast("string")).alias("node"), vector.alias("version_vector"), ((k * (pos + 3)) % 5).cast("double").alias("timestamp"))


_COPY = "SELECT o_orderkey, pos, 'n' || pos AS node, CAST(o_orderkey * (pos + 3) % 5 AS DOUBLE) AS timestamp, CASE pos WHEN 0 THEN o_orderkey % 3 WHEN 1 THEN o_orderkey % 2 ELSE 1 END AS a, CASE pos WHEN 0 THEN o_orderkey % 2 WHEN 1 THEN o_orderkey % 3 ELSE 0 END AS b FROM orders, range(3) AS r(pos)"


@entry("lww_merge", f"SELECT o_orderkey, node, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY timestamp DESC, pos) AS rn FROM ({_COPY})) WHERE rn = 1")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    return replicas.newest(_copies(spark, d), ["o_orderkey"]).select("o_orderkey", "node", "timestamp")


@entry("siblings_conflict", f"WITH c AS ({_COPY}) SELECT x.o_orderkey, x.node AS node_a, y.node AS node_b FROM c x JOIN c y ON x.o_orderkey = y.o_orderkey AND x.pos < y.pos WHERE (x.a > y.a OR x.b > y.b) AND (x.a < y.a OR x.b < y.b)")
def siblings_conflict(spark: SparkSession, d: str) -> DataFrame:
    return replicas.siblings(_copies(spark, d), ["o_orderkey"])


# --- ring, quorum, migration ---


def _tokens(nodes) -> str:
    return f"SELECT md5(node || ':' || i) AS tok, node FROM (SELECT unnest([{', '.join(repr(n) for n in nodes)}]) AS node), range(100) AS r(i)"


def _placement(nodes, where: str = "true") -> str:
    """key, node, pos: the first three nodes by their nearest token above the hash, around the ring."""
    return f"""SELECT k, node, pos FROM (
      SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY near) - 1 AS pos FROM (
        SELECT k, node, min(CASE WHEN tok > h THEN '0' || tok ELSE '1' || tok END) AS near
        FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders WHERE {where}), ({_tokens(nodes)}) GROUP BY k, node)) WHERE pos < 3"""


def _order_keys(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return orders(spark, d).where(where).select(F.col("o_orderkey").alias("k"))


@entry("ring_tokens", _tokens(FIVE.nodes))
def ring_tokens(spark: SparkSession, d: str) -> DataFrame:
    return FIVE.tokens_frame(spark)


@entry("ring_primary", f"SELECT k, node FROM ({_placement(FIVE.nodes)}) WHERE pos = 0")
def ring_primary(spark: SparkSession, d: str) -> DataFrame:
    return FIVE.place(_order_keys(spark, d), F.col("k")).select("k", primary(F.col("replicas")).alias("node"))


@entry("ring_replicas", f"SELECT k, string_agg(node, ',' ORDER BY pos) AS replicas FROM ({_placement(FIVE.nodes)}) GROUP BY k")
def ring_replicas(spark: SparkSession, d: str) -> DataFrame:
    return FIVE.place(_order_keys(spark, d), F.col("k")).select("k", F.array_join("replicas", ",").alias("replicas"))


@entry("ring_balance", f"SELECT node, count(*) AS n FROM ({_placement(FIVE.nodes)}) WHERE pos = 0 GROUP BY node")
def ring_balance(spark: SparkSession, d: str) -> DataFrame:
    return balance(FIVE.place(_order_keys(spark, d), F.col("k"))).withColumnRenamed("count", "n")


@entry("ring_add_node", f"SELECT k, string_agg(node, ',' ORDER BY pos) AS replicas FROM ({_placement(SIX.nodes)}) GROUP BY k")
def ring_add_node(spark: SparkSession, d: str) -> DataFrame:
    return SIX.place(_order_keys(spark, d), F.col("k")).select("k", F.array_join("replicas", ",").alias("replicas"))


@entry("ring_remove_node", f"SELECT k, string_agg(node, ',' ORDER BY pos) AS replicas FROM ({_placement(FIVE.remove('node2').nodes)}) GROUP BY k")
def ring_remove_node(spark: SparkSession, d: str) -> DataFrame:
    return FIVE.remove("node2").place(_order_keys(spark, d), F.col("k")).select("k", F.array_join("replicas", ",").alias("replicas"))


def _moves(before, after) -> str:
    """Both placements as one list per key, so that the rest is work within the row."""
    return f"""WITH o AS MATERIALIZED (SELECT k, list(node ORDER BY pos) AS old FROM ({_placement(before)}) GROUP BY k),
      n AS MATERIALIZED (SELECT k, list(node ORDER BY pos) AS new FROM ({_placement(after)}) GROUP BY k)
      SELECT key, source, target FROM (
        SELECT n.k AS key, list_filter(old, lambda x: list_contains([{', '.join(repr(x) for x in after)}], x))[1] AS source,
               unnest(list_filter(new, lambda x: NOT list_contains(old, x))) AS target
        FROM n JOIN o ON n.k = o.k)"""


@entry("migrate_add", _moves(FIVE.nodes, SIX.nodes))
def migrate_add(spark: SparkSession, d: str) -> DataFrame:
    return migration_plan(FIVE, SIX, _order_keys(spark, d), "k")


@entry("migrate_remove", _moves(SIX.nodes, FIVE.nodes))
def migrate_remove(spark: SparkSession, d: str) -> DataFrame:
    return migration_plan(SIX, FIVE, _order_keys(spark, d), "k")


@entry("migrate_drops", f"SELECT o.k AS key, o.node FROM ({_placement(FIVE.nodes)}) o LEFT JOIN ({_placement(SIX.nodes)}) n ON o.k = n.k AND o.node = n.node WHERE n.node IS NULL")
def migrate_drops(spark: SparkSession, d: str) -> DataFrame:
    return drops(FIVE, SIX, _order_keys(spark, d), "k")


@entry("missing_copies", f"SELECT k, node FROM ({_placement(FIVE.nodes)}) WHERE pos <> k % 3")
def missing_copies_(spark: SparkSession, d: str) -> DataFrame:
    held = FIVE.place(_order_keys(spark, d), F.col("k")).select("k", F.get("replicas", (F.col("k") % 3).cast("int")).alias("node"))
    return missing_copies(FIVE, held, "k", "node")


_LIVE = ", ".join(repr(n) for n in LIVE)


@entry("quorum_write", f"SELECT k, CAST(count(*) FILTER (node IN ({_LIVE})) AS INTEGER) AS acks, count(*) FILTER (node IN ({_LIVE})) >= 2 AS success FROM ({_placement(FIVE.nodes)}) GROUP BY k")
def quorum_write(spark: SparkSession, d: str) -> DataFrame:
    return replicas.write(FIVE, _order_keys(spark, d), "k", LIVE, w=2).select("k", "acks", "success")


_WRITTEN = f"SELECT *, CAST((k * (pos + 2)) % 4 AS DOUBLE) AS timestamp FROM ({_placement(FIVE.nodes)}) WHERE node IN ({_LIVE})"


@entry("quorum_read", f"SELECT k, node, timestamp, n AS replicas_read FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY timestamp DESC, pos) AS rn, count(*) OVER (PARTITION BY k) AS n FROM ({_WRITTEN})) WHERE rn = 1 AND n >= 2")
def quorum_read(spark: SparkSession, d: str) -> DataFrame:
    written = replicas.write(FIVE, _order_keys(spark, d), "k", LIVE, w=2)
    copies = replicas.copies_of(written, LIVE).withColumn("timestamp", ((F.col("k") * (F.col("replica_pos") + 2)) % 4).cast("double"))
    return replicas.read(copies, ["k"], LIVE, r=2).select("k", "node", "timestamp", "replicas_read")


# --- shapes of documents ---


@entry("embed_items", "SELECT o_orderkey, CAST(count(l_orderkey) AS INTEGER) AS n_items, coalesce(sum(l_quantity), 0.0) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def embed_items(spark: SparkSession, d: str) -> DataFrame:
    docs = modeling.embed(orders(spark, d), "o_orderkey", read_table(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_quantity"], "items", ["l_linenumber", "l_partkey"])
    return docs.select("o_orderkey", F.size("items").alias("n_items"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


@entry("unwind_items", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def unwind_items(spark: SparkSession, d: str) -> DataFrame:
    docs = modeling.embed(orders(spark, d), "o_orderkey", read_table(spark, d, "lineitem"), "l_orderkey", ["l_partkey", "l_quantity"], "items", ["l_linenumber", "l_partkey"])
    return modeling.unwind(docs, "items", ["o_orderkey"])


@entry("resolve_ref", "SELECT o_orderkey, c_name AS user_c_name, c_mktsegment AS user_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def resolve_ref(spark: SparkSession, d: str) -> DataFrame:
    users = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return modeling.resolve(orders(spark, d), "o_custkey", users, "c_custkey", "user").select("o_orderkey", "user_c_name", "user_c_mktsegment")


@entry("snapshot_embed", "SELECT o_orderkey, c_name AS name, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def snapshot_embed(spark: SparkSession, d: str) -> DataFrame:
    users = modeling.snapshot(read_table(spark, d, "customer"), "c_nationkey", read_table(spark, d, "nation"), "n_nationkey", ["n_name"], "home")
    docs = modeling.snapshot(orders(spark, d), "o_custkey", users, "c_custkey", ["c_name", "home"], "user")
    return docs.select("o_orderkey", F.col("user.c_name").alias("name"), F.col("user.home.n_name").alias("nation"))


@entry("tree_path", "SELECT 'r' || r_regionkey AS id, 0 AS level, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_path(spark: SparkSession, d: str) -> DataFrame:
    top = read_table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    low = read_table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("name"))
    return modeling.tree(top.union(low), "id", "parent", "name")


@entry("rating_stats", "SELECT event_type, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    return modeling.statistics(read_table(spark, d, "events"), ["event_type"], F.col("value"))


@entry("time_range_stats", "SELECT user_id, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value) AS mean, min(value) AS low, max(value) AS high FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id")
def time_range_stats(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    span = {"ts": {"$gte": datetime.datetime(2024, 1, 2), "$lt": datetime.datetime(2024, 1, 20, 12)}}
    return modeling.statistics(events.filter(filters.compile_filter(span, events.schema)), ["user_id"], F.col("value"))


@entry("index_lookup", "SELECT p_partkey, p_brand FROM part WHERE p_size = 15")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return modeling.lookup(part, "p_partkey", modeling.index_table(part, "p_size", "p_partkey"), "15").select("p_partkey", "p_brand")


@entry("stream_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    events = streaming.read_log(spark, path, spark.read.parquet(path).schema)
    return streaming.follow(streaming.latest(events, ["user_id"], ["ts", "event_id"], "event_type"), ["user_id"], scratch.folder(spark), scratch.folder(spark))


# --- the database over its log ---


def _database(spark: SparkSession, **options) -> Database:
    return Database(spark, scratch.folder(spark), **options)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.to_json(F.struct("c_name", "c_nationkey")).alias("data"))


def _held(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.try_variant_get("data", "$.c_name", "string").alias("c_name"), versions.as_text(F.col("version_vector")).alias("vector"))


_PUT_TWICE = "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'local=2' ELSE 'local=1' END AS vector FROM customer"


def _put_twice(spark: SparkSession, d: str) -> Database:
    db, docs = _database(spark), read_table(spark, d, "customer").where("c_custkey % 3 = 0")
    db.put("customers", _customers(spark, d))
    db.put("customers", docs.select(F.col("c_custkey").cast("string").alias("id"), F.to_json(F.struct(F.concat(F.lit("new "), "c_name").alias("c_name"))).alias("data")))
    return db


@entry("db_put", _PUT_TWICE)
def db_put(spark: SparkSession, d: str) -> DataFrame:
    return _held(_put_twice(spark, d).current("customers"))


@entry("db_delete", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, 'local=1' AS vector FROM customer WHERE c_nationkey >= 10")
def db_delete(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.put("customers", _customers(spark, d))
    db.delete("customers", read_table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("id")))
    return _held(db.current("customers"))


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes of one collection per kind, older ones of the same key among them."""
    vector = F.create_map(F.lit("n"), F.col("event_id"))
    return read_table(spark, d, "events").select(F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("id"), F.parse_json(F.to_json(F.struct("event_id"))).alias("data"), vector.alias("version_vector"), F.col("event_id").cast("double").alias("timestamp"))


_LAST_OF_KIND = "SELECT event_type AS collection, CAST(user_id AS VARCHAR) AS id, max(event_id) AS event_id FROM events GROUP BY event_type, user_id"


def _event_of(docs: DataFrame) -> DataFrame:
    return docs.select("collection", "id", F.try_variant_get("data", "$.event_id", "bigint").alias("event_id"))


@entry("db_raw_put", _LAST_OF_KIND)
def db_raw_put(spark: SparkSession, d: str) -> DataFrame:
    """Two raw puts of many collections, the newer half of all envelopes first."""
    db, rows = _database(spark), _envelopes(spark, d)
    db.raw_put(rows.where("timestamp % 2 = 0"))
    db.raw_put(rows.where("timestamp % 2 = 1"))
    return _event_of(db.current())


@entry("db_raw_keys", "SELECT DISTINCT lower(hex(event_type || ':' || user_id)) AS key FROM events")
def db_raw_keys(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.raw_put(_envelopes(spark, d))
    return db.raw_keys()


@entry("db_raw_get", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, 'local=1' AS vector FROM customer WHERE c_custkey = 7")
def db_raw_get(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.put("customers", _customers(spark, d))
    return _held(db.raw_get(b"customers:7".hex()))


@entry("db_collections", "SELECT DISTINCT event_type AS collection FROM events WHERE event_type <> 'view'")
def db_collections(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.raw_put(_envelopes(spark, d))
    if "view" in db.collections():
        db.drop("view")
    return spark.createDataFrame([(c,) for c in db.collections()], "collection string")


@entry("db_drop_all", "SELECT 0 AS n")
def db_drop_all(spark: SparkSession, d: str) -> DataFrame:
    db = _database(spark)
    db.raw_put(_envelopes(spark, d))
    db.drop_all()
    return db.current().agg(F.count(F.lit(1)).cast("int").alias("n"))


@entry("db_backup_restore", _PUT_TWICE)
def db_backup_restore(spark: SparkSession, d: str) -> DataFrame:
    db, target = _put_twice(spark, d), scratch.folder(spark)
    db.backup(target)
    db.drop_all()
    db.restore(target)
    return _held(db.current("customers"))


@entry("db_compact_levels", f"SELECT *, 'L1' AS level FROM ({_LAST_OF_KIND})")
def db_compact_levels(spark: SparkSession, d: str) -> DataFrame:
    """Four segments of level 0 are due and become one of level 1, with the same state."""
    db, rows = _database(spark), _envelopes(spark, d)
    for i in range(4):
        db.raw_put(rows.where(F.col("timestamp") % 4 == i))
    while db.compact():
        pass
    levels = {re.match(r"L\d+", s)[0] for s in db.segments()}
    return _event_of(db.current()).withColumn("level", F.lit(",".join(sorted(levels))))


def _three(spark: SparkSession, **options) -> Database:
    nodes = tuple((f"node{i}", "localhost", 8080 + i) for i in (1, 2, 3, 4, 5))
    return _database(spark, settings=Settings(nodes=nodes), **options)


_CUSTOMER_PLACE = _placement(FIVE.nodes).replace("SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders", "SELECT c_custkey AS k, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer")


@entry("db_replicas", f"SELECT CAST(k AS VARCHAR) AS id, node, CAST(pos AS INTEGER) AS replica_pos FROM ({_CUSTOMER_PLACE})")
def db_replicas(spark: SparkSession, d: str) -> DataFrame:
    db = _three(spark)
    db.put("customers", _customers(spark, d))
    return db.copies("customers").select("id", "node", "replica_pos")


_CUSTOMER_SIX = _placement(SIX.nodes).replace("SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders", "SELECT c_custkey AS k, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer")


@entry("db_add_node", f"SELECT CAST(k AS VARCHAR) AS id, node FROM ({_CUSTOMER_PLACE}) UNION SELECT CAST(k AS VARCHAR), node FROM ({_CUSTOMER_SIX})")
def db_add_node(spark: SparkSession, d: str) -> DataFrame:
    """All copies after a sixth node has joined: its own are pushed to it, the others stay."""
    db = _three(spark)
    db.put("customers", _customers(spark, d))
    db.add_node("node6", "localhost", 8086)
    return db.copies("customers").select("id", "node")


@entry("db_remove_node", f"SELECT CAST(k AS VARCHAR) AS id, node FROM ({_CUSTOMER_PLACE}) WHERE node <> 'node2' UNION SELECT CAST(k AS VARCHAR), node FROM ({_CUSTOMER_PLACE.replace(_tokens(FIVE.nodes), _tokens(FIVE.remove('node2').nodes))})")
def db_remove_node(spark: SparkSession, d: str) -> DataFrame:
    """All copies after a node has left: what only it would have had of the new owners' is copied from the others."""
    db = _three(spark)
    db.put("customers", _customers(spark, d))
    db.remove_node("node2")
    return db.copies("customers").select("id", "node")


@entry("db_quorum_get", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, CAST(3 AS BIGINT) AS replicas_read FROM customer WHERE c_custkey = 11")
def db_quorum_get(spark: SparkSession, d: str) -> DataFrame:
    db = _three(spark)
    db.put("customers", _customers(spark, d))
    return db.get("customers", "11").select("id", F.try_variant_get("data", "$.c_name", "string").alias("c_name"), "replicas_read")


@entry("bloom_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 13")
def bloom_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup in files that hold ranges of the key and a Bloom filter on it."""
    path = scratch.folder(spark)
    tables.write_sorted(orders(spark, d), path, "o_custkey", 8)
    return spark.read.schema(orders(spark, d).schema).parquet(path).filter("o_custkey = 13").select("o_orderkey", "o_custkey", "o_totalprice")


@entry("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 300")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan of a range of keys over sorted files, of which the others are skipped by their statistics."""
    path = scratch.folder(spark)
    tables.write_sorted(orders(spark, d), path, "o_orderkey", 8)
    kept = spark.read.schema(orders(spark, d).schema).parquet(path)
    return kept.filter(filters.compile_filter({"o_orderkey": {"$gte": 100, "$lt": 300}}, kept.schema)).select("o_orderkey", "o_totalprice")


def _refused(asked) -> str:
    try:
        asked()
        return "taken"
    except ValueError:
        return "refused"


@entry("page_negative", "SELECT * FROM (VALUES ('limit -1', 'refused'), ('offset -1', 'refused'), ('limit 0', 'taken'), ('offset 0', 'taken')) AS t(asked, answer)")
def page_negative(spark: SparkSession, d: str) -> DataFrame:
    cases = [("limit", -1), ("offset", -1), ("limit", 0), ("offset", 0)]
    rows = [(f"{name} {n}", _refused(lambda name=name, n=n: query.run(orders(spark, d), {name: n}, "o_orderkey"))) for name, n in cases]
    return spark.createDataFrame(rows, "asked string, answer string")


@entry("ring_address", "SELECT 'node' || i AS node, 'http://localhost:' || 8080 + i AS address FROM range(1, 4) AS r(i)")
def ring_address(spark: SparkSession, d: str) -> DataFrame:
    config = {"cluster": {"replication_factor": 3}, "nodes": {f"node{i}": {"host": "localhost", "port": 8080 + i} for i in (1, 2, 3)}}
    ring = Settings.of(config).ring()
    return spark.createDataFrame([(n, ring.address(n)) for n in ring.nodes], "node string, address string")


@entry("quorum_strong", "SELECT CAST(w AS INTEGER) AS w, CAST(r AS INTEGER) AS r, w + r > 3 AS strong FROM range(1, 4) AS a(w), range(1, 4) AS b(r)")
def quorum_strong(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(w, r, versions.strong(w, r, 3)) for w in (1, 2, 3) for r in (1, 2, 3)], "w int, r int, strong boolean")


@entry("settings_page", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY id LIMIT 7 OFFSET 3")
def settings_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the size that the settings name."""
    db = _database(spark, settings=Settings(replication_factor=1, write_quorum=1, read_quorum=1, query_limit=7, query_offset=3))
    db.put("customers", _customers(spark, d))
    return db.query("customers", {}).select("id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a status above a price, most expensive first."""
    body = {"filter": {"o_orderstatus": "P", "o_totalprice": {"$gte": 1000}}, "sort": {"o_totalprice": -1}, "limit": 10, "fields": ORDER_FIELDS}
    return query.run(orders(spark, d), body, "o_orderkey")
