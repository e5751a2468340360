"""A document database over a log of operations in Parquet.

Every write is one segment, <path>/log/segment=L0_<number>-<id>, written aside and then renamed, so that readers see all of
it or nothing. Its files are in the order of keys, so that a collection or a key is found by their statistics and Bloom
filters, however many collections there are. An operation is held once per copy: node says whose, replica_pos is that node's place in the
key's replica set. Reads see the newest operation of each key among the live nodes. The methods follow the operations of a
document store's API, one each, on batches. Nothing is changed in place: compact() merges segments into one of the next
level and then removes those that it read. A dropped collection is a mark that hides what was written before. Numbers grow from segment to segment, also where clients' clocks differ.
"""

from __future__ import annotations

import math
import re
import threading
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import keys, versions
from docengine.operators import filters, oplog, query, replicas
from docengine.operators.ring import Ring
from docengine.sources.scratch import materialize
from docengine.sources.settings import Settings

LOG = "seq bigint, op string, id string, data variant, version_vector map<string,bigint>, timestamp double, node string, replica_pos int, collection string"
ENVELOPE = ("id", "collection", "data", "version_vector", "timestamp")
COPY = ("collection", "id", "node")
#: Bytes of one file of a compacted segment.
FILE_BYTES = 128 << 20


class NotFound(KeyError):
    """No such document or collection."""


class Database:
    def __init__(self, spark: SparkSession, path: str, ring: Ring | None = None, node: str | None = None, live: Sequence[str] | None = None, settings: Settings | None = None):
        """Without a ring, the members of settings; without either, one node with one copy."""
        if settings is None:
            few = min(2, ring.replication) if ring else 1
            settings = Settings(replication_factor=ring.replication, write_quorum=few, read_quorum=few) if ring else Settings.single()
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        self.ring = ring or (settings.ring() if settings.nodes else Ring.of(node or "local", replication=1))
        self.node = node or self.ring.nodes[0]
        self.live = tuple(self.ring.nodes if live is None else live)

    # --- the log ---

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def segments(self) -> list[str]:
        """Names of the segments, L<level>_<number>-<id>. How many there are is bounded by compaction, not by the data."""
        fs, path = self._fs()
        folder = path(f"{self.path}/log")
        return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _at(self, segment: str) -> str:
        return f"{self.path}/log/segment={segment}"

    def _drops(self) -> dict[str, int]:
        """The number of the last drop of each dropped collection; marks go with the next whole compaction."""
        fs, path = self._fs()
        folder = path(f"{self.path}/dropped")
        marks = [s.getPath().getName().partition("-") for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found: dict[str, int] = {}
        for number, _, name in sorted(marks):
            found[bytes.fromhex(name).decode()] = int(number)
        return found

    def _read(self, segments: Sequence[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], LOG)
        ops = self.spark.read.schema(f"{LOG}, segment string").option("basePath", f"{self.path}/log").parquet(*map(self._at, segments)).drop("segment")
        if drops := self._drops():
            last = F.try_element_at(F.create_map(*(F.lit(x) for pair in drops.items() for x in pair)), F.col("collection"))
            ops = ops.where(last.isNull() | (F.col("seq") > last))
        return ops

    def log(self, collection: str | None = None) -> DataFrame:
        """All operations, of one collection or of all. Files that cannot be read are skipped by spark.sql.files.ignoreCorruptFiles."""
        ops = self._read(self.segments())
        return ops if collection is None else ops.where(F.col("collection") == keys.check_collection(collection))

    def _number(self) -> int:
        """Above the numbers of all segments and drops that there are."""
        found = [int(m[1]) for s in self.segments() if (m := re.match(r"L\d+_(\d+)-", s))]
        return max([time.time_ns(), *(n + 1 for n in [*found, *self._drops().values()])])

    def _commit(self, rows: DataFrame, level: int, number: int) -> None:
        fs, path = self._fs()
        name = f"L{level}_{number:020d}-{uuid.uuid4().hex[:8]}"
        aside = path(f"{self.path}/aside/{name}")
        rows = rows.select("seq", "op", "id", "data", "version_vector", "timestamp", "node", "replica_pos", "collection")
        rows.sortWithinPartitions("collection", "id").write.option("parquet.bloom.filter.enabled#id", "true").parquet(aside.toString())
        fs.mkdirs(path(f"{self.path}/log"))
        if not fs.rename(aside, path(self._at(name))):
            raise RuntimeError(f"cannot commit {name}")

    def _copies(self, ops: DataFrame) -> DataFrame:
        """ops once for each live node of the key's replica set."""
        if len(self.ring.nodes) == 1:
            only = self.ring.nodes[0]
            return ops.withColumns({"node": F.lit(only), "replica_pos": F.lit(0)}).where(F.lit(only in self.live))
        return replicas.copies_of(self.ring.place(ops, F.col("id")), self.live)

    def _append(self, ops: DataFrame) -> None:
        """Commits ops (op and the envelope) as one segment. A collection's rows are gathered, and split if they are many."""
        number = self._number()
        self._commit(self._copies(ops).withColumn("seq", F.lit(number)).hint("rebalance", "collection"), 0, number)

    def _live(self, ops: DataFrame) -> DataFrame:
        return ops.where(F.col("node").isin(*self.live) if self.live else F.lit(False))

    def _state(self, ops: DataFrame) -> DataFrame:
        return oplog.replay(self._live(ops)).select(*ENVELOPE)

    def current(self, collection: str | None = None) -> DataFrame:
        """The visible documents, of one collection or of all: id, collection, data, version_vector, timestamp."""
        return self._state(self.log(collection))

    def copies(self, collection: str | None = None) -> DataFrame:
        """The newest copy of each document on each live node, deletes left out."""
        return oplog.replay(self._live(self.log(collection)), COPY).select(*ENVELOPE, "node", "replica_pos")

    def conflicts(self, collection: str) -> DataFrame:
        """Pairs of copies of one document whose vectors conflict: id, node_a, node_b."""
        return replicas.siblings(self.copies(collection), ["id"])

    # --- documents ---

    def _known(self, collection: str, ids: DataFrame) -> DataFrame:
        """The current documents with these ids. The log meets the ids before it is replayed."""
        return self._state(self.log(collection).join(ids.select("id"), "id", "left_semi"))

    def _quorum(self, docs: DataFrame, w: int) -> None:
        """Raises if a document's live replicas are fewer than w; nothing has been written then."""
        versions.check_quorum(w, max(self.ring.replication, 1))
        if len(self.ring.nodes) < w or set(self.ring.nodes) - set(self.live):
            short = replicas.write(self.ring, docs.select("id"), "id", self.live, w).where(~F.col("success"))
            if short.limit(1).count():
                raise RuntimeError(f"no write quorum: some documents have fewer than {w} live replicas")

    def _when(self, timestamp: float | None) -> Column:
        return F.lit(float(time.time() if timestamp is None else timestamp))

    def put(self, collection: str, docs: DataFrame, w: int | None = None, timestamp: float | None = None) -> None:
        """Replaces whole documents; docs has id (string) and data (VARIANT, or JSON text).

        w live replicas must take each document (the settings' write_quorum). Of several rows with one id, the one with the
        greatest JSON text holds.
        """
        keys.check_collection(collection)
        rows = _with_variant(docs).select(F.col("id").cast("string").alias("id"), "data")
        rows = rows.groupBy("id").agg(F.max_by("data", F.to_json("data")).alias("data"))
        self._quorum(rows, self.settings.write_quorum if w is None else w)
        old = self._known(collection, rows).select("id", F.col("version_vector").alias("old"))
        vector = versions.increment(F.col("old"), F.lit(self.node))
        self._append(rows.join(old, "id", "left").select(F.lit(oplog.PUT).alias("op"), "id", F.lit(collection).alias("collection"), "data", vector.alias("version_vector"), self._when(timestamp).alias("timestamp")))

    def get(self, collection: str, doc_id: str, r: int | None = None) -> DataFrame:
        """The newest of the document's copies, as no or one row; r live replicas must answer (the settings' read_quorum).

        replicas_read tells how many copies were compared. A document with fewer than r of them gives no row.
        """
        r = self.settings.read_quorum if r is None else r
        versions.check_quorum(r, max(self.ring.replication, 1))
        owners = self.ring.replicas_of(doc_id)
        there = [n for n in owners if n in self.live]
        if len(there) < r:
            raise RuntimeError(f"no read quorum: {len(there)} of {len(owners)} replicas are live, {r} answers are asked for")
        held = oplog.newest(self.log(collection).where((F.col("id") == doc_id) & F.col("node").isin(*there)), COPY)
        return replicas.read(held, ["collection", "id"], there, r).where(F.col("op") != oplog.DELETE).select(*ENVELOPE, "replicas_read")

    def one(self, collection: str, doc_id: str, r: int | None = None):
        found = self.get(collection, doc_id, r).withColumn("data", F.to_json("data")).first()
        if found is None:
            raise NotFound(f"{collection}:{doc_id}")
        return found

    def delete(self, collection: str, ids: DataFrame, timestamp: float | None = None) -> None:
        """Writes a delete for each id that has a document; ids has id."""
        keys.check_collection(collection)
        there = self._known(collection, ids.select(F.col("id").cast("string").alias("id")))
        self._append(there.withColumns({"op": F.lit(oplog.DELETE), "data": F.lit(None).cast("variant"), "timestamp": self._when(timestamp)}))

    def write_batch(self, collection: str, ops: DataFrame, timestamp: float | None = None) -> None:
        """Puts and deletes in one append: ops has seq, op, id, data (VARIANT, or JSON text); for one id the highest seq holds."""
        keys.check_collection(collection)
        last = F.max_by(F.struct("op", "data"), F.struct("seq", "op", F.to_json("data"))).alias("last")
        rows = _with_variant(ops).withColumn("id", F.col("id").cast("string")).groupBy("id").agg(last)
        old = self._known(collection, rows).select("id", F.col("version_vector").alias("old"))
        rows = rows.join(old, "id", "left")
        put = F.col("last.op") == oplog.PUT
        self._append(rows.select("last.op", "id", F.lit(collection).alias("collection"), F.when(put, F.col("last.data")).alias("data"), versions.increment(F.col("old"), F.lit(self.node)).alias("version_vector"), self._when(timestamp).alias("timestamp")))

    def put_if(self, collection: str, docs: DataFrame, timestamp: float | None = None) -> DataFrame:
        """Replaces documents whose current vector equals expected; returns id, accepted. docs: id, data, expected."""
        state = self._known(collection, docs)
        tried = oplog.compare_and_set(state, docs.withColumn("collection", F.lit(collection)))
        tried = materialize(tried.select("id", "data", "accepted"))  # decided before the put changes the state
        self.put(collection, tried.where("accepted").select("id", "data"), timestamp=timestamp)
        return tried.select("id", "accepted")

    def query(self, collection: str, body: Mapping) -> DataFrame:
        """Envelopes of the documents that a query asks for; with fields, their ids and those fields."""
        spec = query.QuerySpec.of({"limit": self.settings.query_limit, "offset": self.settings.query_offset} | dict(body))
        page = query.run(self.current(collection), query.QuerySpec(spec.filter, spec.sort, spec.limit, spec.offset), "id", data="data")
        if spec.fields is None:
            return page
        return page.select("id", *(filters.variant_value(F.col("data"), f).alias(f) for f in spec.fields))

    # --- collections ---

    def collections(self) -> list[str]:
        """Names of the collections with a visible document, in order."""
        return sorted(r[0] for r in self.current().select("collection").distinct().collect())

    def page(self, collection: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        asked = {"limit": limit, "offset": offset}
        return self.query(collection, {k: v for k, v in asked.items() if v is not None})

    def drop(self, collection: str) -> None:
        if not self.log(collection).limit(1).count():
            raise NotFound(collection)
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/dropped"))
        fs.create(path(self._mark(collection, self._number()))).close()

    def _mark(self, collection: str, number: int) -> str:
        return f"{self.path}/dropped/{number:020d}-{collection.encode().hex()}"

    def drop_all(self) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/log"), True)
        fs.delete(path(f"{self.path}/dropped"), True)

    # --- raw keys ---

    def raw_keys(self) -> DataFrame:
        """All visible keys in hexadecimal."""
        return self.current().select(keys.to_hex(keys.encode_key(F.col("collection"), F.col("id"))).alias("key"))

    def raw_get(self, hex_key: str) -> DataFrame:
        try:
            collection, _, doc_id = bytes.fromhex(hex_key).decode().partition(":")
        except ValueError as e:
            raise ValueError(f"not a key: {hex_key!r}") from e
        return self.get(collection, doc_id)

    def raw_put(self, docs: DataFrame) -> None:
        """Envelopes of any number of collections as they are, without a new vector, in one segment.

        The newest timestamp holds when they are read; of rows with one key and timestamp, the one with the greatest JSON
        text. A name that is no collection's fails the whole write.
        """
        name = F.col("collection")
        fine = F.coalesce((name != "") & ~F.contains(name, F.lit(":")), F.lit(False))
        checked = F.when(fine, name).otherwise(F.raise_error(F.concat(F.lit("not a collection name: "), F.coalesce(name, F.lit("null")))).cast("string"))
        rest = F.struct("data", "version_vector", "timestamp")
        rows = docs.groupBy("collection", "id").agg(F.max_by(rest, F.struct("timestamp", F.to_json("data"))).alias("last"))
        self._append(rows.select(F.lit(oplog.PUT).alias("op"), "id", checked.alias("collection"), "last.*"))

    # --- members ---

    def add_node(self, name: str, host: str | None = None, port: int | None = None) -> None:
        """Makes a node a member, live, and copies to it what it now owns."""
        self.ring, self.live = self.ring.add(name, host, port), (*self.live, name)
        self.repair()

    def remove_node(self, name: str) -> None:
        """Ends a node's membership and copies what it held from the others to the nodes that own it now."""
        self.ring, self.live = self.ring.remove(name), tuple(n for n in self.live if n != name)
        self.repair()

    def repair(self) -> None:
        """Writes the copies that the ring calls for and a live node lacks, or has older than another live node's."""
        held = oplog.newest(self._live(self.log()), COPY).select(*COPY, F.col("timestamp").alias("have"), F.col("seq").alias("have_seq"))
        newest = oplog.newest(self._live(self.log())).drop("node", "replica_pos")
        wanted = self._copies(newest).join(held, list(COPY), "left")
        behind = F.col("have").isNull() | (F.struct("have", "have_seq") < F.struct("timestamp", "seq"))
        rows = wanted.where(behind & ((F.col("op") != oplog.DELETE) | F.col("have").isNotNull()))
        self._commit(rows.hint("rebalance", "collection"), 0, self._number())

    # --- upkeep ---

    def _bytes(self, segment: str) -> int:
        fs, path = self._fs()
        return fs.getContentSummary(path(self._at(segment))).getLength()

    def _plan(self) -> list[tuple[str, int, int]]:
        """Name, bytes and level to write of the segments that the next compaction reads."""
        sizes = [(s, self._bytes(s)) for s in self.segments()]
        if not sizes:
            return []
        given = self.settings
        plan = oplog.compaction_plan(self.spark.createDataFrame(sizes, "name string, size long"), given.l0_file_num_threshold, given.base_level_size_mb, given.level_size_multiplier)
        return [(r["name"], r["size"], r["to_level"]) for r in plan.collect()]  # segments, whose number is bounded

    def due(self) -> bool:
        """Whether a level has enough segments, or is large enough, to be merged into the next."""
        return bool(self._plan())

    def compact(self, whole: bool = False) -> bool:
        """Merges the segments of the level that is due into the next level, or with whole all segments into one.

        Returns whether there was anything to do. The merged segment has files of FILE_BYTES in the order of keys. Deletes
        go only if nothing older can be left elsewhere. Segments that come meanwhile stay. A reader that has listed the
        segments before they go must list them again.
        """
        every = self.segments()
        if whole:
            plan = [(s, self._bytes(s), max(int(re.match(r"L(\d+)_", x)[1]) for x in every) + 1) for s in every]
        else:
            plan = self._plan()
        if not plan:
            return False
        picked = [s for s, _, _ in plan]
        number = max(int(re.match(r"L\d+_(\d+)-", s)[1]) for s in picked)
        rows = oplog.newest(self._read(picked), COPY)
        if set(picked) == set(every):
            rows = rows.where(F.col("op") != oplog.DELETE)
        files = math.ceil(sum(n for _, n, _ in plan) / FILE_BYTES)
        marks = self._drops()
        self._commit(rows.repartitionByRange(max(files, 1), "collection", "id"), plan[0][2], number)
        fs, path = self._fs()
        for segment in picked:
            fs.delete(path(self._at(segment)), True)
        if set(picked) == set(every):
            for name, when in marks.items():
                fs.delete(path(self._mark(name, when)), False)
        return True

    def keep_compacted(self) -> threading.Event:
        """Looks for due compactions every compaction_seconds, in a thread of the driver, until the returned event is set."""
        stop = threading.Event()

        def watch() -> None:
            while not stop.wait(self.settings.compaction_seconds):
                while not stop.is_set() and self.compact():
                    pass

        threading.Thread(target=watch, daemon=True).start()
        return stop

    def _copy(self, source: str, target: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)

    def backup(self, target: str) -> None:
        """A copy of the whole log in another folder. Dropped collections are left out by a whole compaction before."""
        if self._drops():
            self.compact(whole=True)
        self._copy(f"{self.path}/log", target)

    def restore(self, source: str) -> None:
        """Replaces the log by a backup, which is copied aside first."""
        fs, path = self._fs()
        aside = f"{self.path}/aside/restore-{uuid.uuid4().hex}"
        fs.mkdirs(path(f"{self.path}/aside"))
        self._copy(source, aside)
        self.drop_all()
        if not fs.rename(path(aside), path(f"{self.path}/log")):
            raise RuntimeError(f"cannot restore {source}")


def _with_variant(docs: DataFrame) -> DataFrame:
    return docs.withColumn("data", F.parse_json("data")) if docs.schema["data"].dataType.typeName() == "string" else docs
