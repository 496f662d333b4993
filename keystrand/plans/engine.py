"""Registered queries that go through a database: commits, leases, compaction, journals, transactions.

Each opens a database of its own in the folder that all executors share
(spark.checkpoint.dir; a temporary one only in a local session without it), writes
driver tables to it, and reads the answer back from its files.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand import errors
from keystrand.operators import maintain, read, write
from keystrand.operators.cas import ContentStore
from keystrand.operators.tx import Optimistic, SingleWriter
from keystrand.plans.catalogue import Tables, query, user_key
from keystrand.sources.journal import encode_batch, read_journals
from keystrand.sources.store import Database, Files

_made: list = []


def workspace(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}"
    path = f"{named.rstrip('/')}/keystrand-db-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have been stopped
            Files(spark, path).delete("")
    _made.clear()


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).customer.select(user_key("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), "c_mktsegment", "c_custkey")


_KEY = "lpad(CAST(c_custkey AS VARCHAR),8,'0')"


@query(f"SELECT 'before' AS at, {_KEY} AS key, c_acctbal AS value FROM customer UNION ALL "
       f"SELECT 'now', {_KEY}, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_acctbal + 1 ELSE c_acctbal END FROM customer WHERE c_mktsegment <> 'BUILDING'")  # fmt: skip
def db_ingest_batch_compact(spark, d):
    """Bulk loads of values and of tombstones and a batch, compacted under the lease of an older snapshot."""
    db, c = Database(spark, workspace(spark)), _customers(spark, d)
    ks = db.keyspace("balances", key="string", value="double")
    ks.ingest(c.select("key", "value"))
    with db.snapshot() as before:
        ks.ingest(c.where("c_mktsegment = 'BUILDING'").select("key", F.lit(None).cast("double").alias("value")), kind="T")
        db.batch().insert_all(ks, c.where("c_mktsegment = 'AUTOMOBILE'").select("key", (F.col("value") + 1).alias("value"))).commit()
        ks.major_compact()
        then = read.scan(ks.log(before.instant)).select(F.lit("before").alias("at"), "key", "value")
    return then.unionByName(read.scan(ks.log()).select(F.lit("now").alias("at"), "key", "value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 1")
def db_clear_and_reopen(spark, d):
    """A keyspace is loaded, cleared and loaded again; another handle reads it."""
    db, o = Database(spark, workspace(spark)), Tables(spark, d).orders.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("value"))
    ks = db.keyspace("orders", key="string", value="double")
    ks.ingest(o)
    ks.clear()
    ks.ingest(o.where("cast(key as long) % 3 = 1"))
    ks.major_compact()
    db.vacuum()
    return read.scan(Database(spark, db.root).keyspace("orders").log()).select("key", "value")


@query(f"SELECT 'active' AS keyspace, {_KEY} AS key, c_acctbal AS value FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'overdrawn', {_KEY}, c_acctbal FROM customer WHERE c_acctbal < 0")
def db_move(spark, d):
    """Items that satisfy a predicate go to another keyspace in one commit."""
    db, c = Database(spark, workspace(spark)), _customers(spark, d)
    a, b = (db.keyspace(n, key="string", value="double") for n in ("active", "overdrawn"))
    a.ingest(c.select("key", "value"))
    commits = len(db._commits)
    a.move_where(b, F.col("value") < 0)
    if len(db._commits) != commits + 1:
        raise AssertionError("a move is one commit")
    each = [read.scan(k.log()).select(F.lit(k.name).alias("keyspace"), "key", "value") for k in (a, b)]
    return each[0].unionByName(each[1])


@query("WITH m AS (SELECT concat(lpad(CAST(conv_id AS VARCHAR), 8, '0'), '/', lpad(CAST(turn AS VARCHAR), 4, '0')) AS key, role FROM conversations), n AS (SELECT *, row_number() OVER (ORDER BY key) AS rn FROM m) "
       "SELECT CASE WHEN rn <= 25 THEN 'taken' ELSE 'left' END AS at, key, role FROM n")  # fmt: skip
def db_queue(spark, d):
    """Messages are queued; two consumers take the first ten and the next fifteen, which then are gone."""
    db, c = Database(spark, workspace(spark)), Tables(spark, d).conversations
    ks = db.keyspace("queue", key="string", value="string")
    ks.ingest(c.select(F.concat_ws("/", F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("key"), F.col("role").alias("value")))
    taken = [("taken", k, v) for k, v in ks.dequeue(10) + ks.dequeue(15)]
    left = read.scan(ks.log()).select(F.lit("left").alias("at"), "key", F.col("value").alias("role"))
    return spark.createDataFrame(taken, "at string, key string, role string").unionByName(left)


@query("WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'changed' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL) SELECT sha256(text) AS sha, count(*) AS refs, max(CAST(strlen(text) AS INTEGER)) AS size FROM l GROUP BY ALL")
def db_content_addresses(spark, d):
    """Texts by content address with counted references: all are put, some changed, some removed; what nothing refers to is gone."""
    db, t = Database(spark, workspace(spark)), Tables(spark, d).documents.where("text is not null").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"))
    cas = ContentStore(db, "texts")
    cas.put(t)
    cas.put(t.where("cast(key as long) % 5 = 1").select("key", F.lit("changed").alias("value")))
    cas.remove(t.where("cast(key as long) % 3 = 0").select("key"))
    refs = read.scan(cas.counts.log()).select(F.col("key").alias("sha"), F.col("value").alias("refs"))
    blobs = read.scan(cas.blobs.log()).select(F.col("key").alias("sha"), F.octet_length("value").alias("size"))
    # An outer join, so that a blob or a count too many would show.
    return refs.join(blobs, "sha", "full")


@query("SELECT CAST(event_id AS VARCHAR) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS k FROM events")
def db_migrate_eagerly(spark, d):
    """A keyspace is rewritten into a new one, which takes its place; the old one is dropped."""
    db, e = Database(spark, workspace(spark)), Tables(spark, d).events
    old = db.keyspace("props/1", key="string", value="string")
    old.ingest(e.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value")))
    new = db.keyspace("props/2", key="string", value="long")
    new.ingest(read.scan(old.log()).select("key", (F.from_json("value", "k bigint")["k"] * 10).alias("value")))
    db.delete_keyspace(old)
    db.vacuum()
    if db.list_keyspace_names() != ["props/2"]:
        raise AssertionError("the old keyspace is still there")
    return read.scan(new.log()).select("key", F.col("value").alias("k"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem WHERE l_orderkey < 200 AND l_orderkey % 7 <> 3), "
       "r AS (SELECT l_linenumber AS line, l_partkey AS part, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey DESC, n DESC) AS rn FROM b) SELECT CAST(line AS VARCHAR) AS key, CAST(part AS VARCHAR) AS value FROM r WHERE rn = 1")  # fmt: skip
def db_journal(spark, d):
    """Orders as framed batches in journal files, some of which break off in their last batch; the state after replay."""
    files = Files(spark, workspace(spark))
    rows = Tables(spark, d).lineitem.where("l_orderkey < 200").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey").collect()  # bounded by the predicate
    orders: dict[int, list] = {}
    for o, line, part in rows:
        orders.setdefault(o, []).append((1, "V", str(line).encode(), str(part).encode()))
    for start in range(0, 200, 7):
        # A file holds the batches of four orders; the last is torn (it is the one with o % 7 = 3).
        for part, broken in (((0, 1, 2, 3), True), ((4, 5, 6), False)):
            data = b"".join(encode_batch(start + k, orders[start + k]) for k in part if start + k in orders)
            if broken and start + 3 in orders:
                data = data[:-9]
            files.put(f"journal/{start:08d}-{part[0]}", data)
    log = read_journals(spark, f"{files.root}/journal")
    return write.merge(log.select("keyspace_id", F.col("key").cast("string").alias("key"), "seqno", "batch_ord", "kind", F.col("value").cast("string").alias("value"))).select("key", "value")


@query("SELECT * FROM (VALUES ('a','310'), ('b','10'), ('outcome 1','ok'), ('outcome 2','conflict'), ('outcome 3','ok'), ('single','2')) t(key, value)")
def db_transactions(spark, d):
    """Two optimistic transactions that read what the other writes, one of them run again, and two single writers in a row."""
    db = Database(spark, workspace(spark))
    ks = db.keyspace("t", key="string", value="string")
    db.batch().insert(ks, "a", "10").insert(ks, "b", "300").commit()
    occ, said = Optimistic(db), []
    one, two = occ.write_tx(), occ.write_tx()
    one.insert(ks, "b", one.get(ks, "a"))
    two.insert(ks, "a", str(int(two.get(ks, "b")) + int(two.get(ks, "a"))))
    for tx in (one, two):
        try:
            tx.commit()
            said.append("ok")
        except errors.Conflict:
            said.append("conflict")
    occ.run(lambda tx: tx.insert(ks, "a", str(int(tx.get(ks, "a")) + int(tx.get(ks, "b")) + 290)))
    said.append("ok")
    writer = SingleWriter(db)
    for _ in range(2):
        with writer.write_tx() as tx:
            tx.update_fetch(ks, "single", lambda v: str(int(v or 0) + 1))
    out = read.scan(ks.log()).select("key", "value")
    return out.unionByName(spark.createDataFrame([(f"outcome {k}", x) for k, x in enumerate(said, 1)], "key string, value string"))


@query("WITH w AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR),8,'0') AS key, value, event_id, event_type FROM events), s AS (SELECT key, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS t FROM w GROUP BY key), "
       f"l AS (SELECT key, value FROM s WHERE t <> 'error'), k AS (SELECT {_KEY} AS key FROM customer WHERE c_custkey % 2 = 0) SELECT k.key, l.value AS prev, coalesce(l.value + 1, 1) AS new FROM k LEFT JOIN l USING (key)")  # fmt: skip
def update_missing_keys(spark, d):
    """Read-modify-write of given keys, of which many do not exist: those start at 1."""
    from keystrand.plans.catalogue import user_log

    keys = _customers(spark, d).where("c_custkey % 2 = 0").select("key")
    return write.update_keys(read.scan(user_log(spark, d)), keys, lambda v: F.coalesce(v + 1, F.lit(1.0))).select("key", "prev", "new")


@query("SELECT {0} AS key, c_acctbal AS value FROM customer WHERE c_acctbal >= 0 OR c_mktsegment <> 'BUILDING'".format(_KEY))
def db_compaction_filter(spark, d):
    """A database that names a compaction filter for one keyspace; the other keeps all."""
    from keystrand.sources.store import Filter

    keep = Filter(lambda k, v: F.when(v < 0, maintain.REMOVE))
    db, c = Database(spark, workspace(spark), filters=lambda name: keep if name == "building" else None), _customers(spark, d)
    out = None
    for name, where in (("building", "c_mktsegment = 'BUILDING'"), ("others", "c_mktsegment <> 'BUILDING'")):
        ks = db.keyspace(name, key="string", value="double")
        ks.ingest(c.where(where).select("key", "value"))
        ks.major_compact()
        rows = read.scan(ks.log()).select("key", "value")
        out = rows if out is None else out.unionByName(rows)
    return out
