"""Registered queries over the driver tables, each with the SQL that must agree with it.

A query builds a keyspace log from a table and applies the engine's operators;
the SQL says the same in another way (row_number for resolution, LIKE for
wildcards, outer joins for merges).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.model import TOMBSTONE, VALUE, Range, as_log, big_endian, from_big_endian
from keystrand.operators import index, maintain, read, transactions, write
from keystrand.operators.resolve import drop_cleared, overlay, resolve, resolve_many

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

S = 5000  # the past instant that most queries read at

LG = "lg AS (SELECT lpad(CAST(user_id AS VARCHAR),8,'0') AS key, event_id AS seqno, CASE WHEN event_type='error' THEN 'T' ELSE 'V' END AS kind, value FROM events)"


def snap(instant: int | None = S, source: str = "lg", name: str = "snap") -> str:
    where = f"WHERE seqno < {instant}" if instant is not None else ""
    return f"{name} AS (SELECT key, value, seqno FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM {source} {where}) t WHERE rn=1 AND kind='V')"


NOW, PAST = f"WITH {LG}, {snap(None)} ", f"WITH {LG}, {snap(S)} "


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def user_key(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 8, "0")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of users' states: errors delete, all other events set the value."""
    e = Tables(spark, sf_dir).events
    return e.select(F.lit(1).cast("long").alias("keyspace_id"), user_key("user_id").alias("key"), F.col("event_id").alias("seqno"), F.lit(0).alias("batch_ord"), F.when(F.col("event_type") == "error", TOMBSTONE).otherwise(VALUE).alias("kind"), "value")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).customer.select("c_custkey", user_key("c_custkey").alias("key"))


# --- scans -------------------------------------------------------------------


@query(NOW + "SELECT key, value, seqno FROM snap")
def scan_latest(spark, d):
    return read.scan(user_log(spark, d))


@query(PAST + "SELECT key, value, seqno FROM snap")
def snapshot_scan(spark, d):
    return read.scan(user_log(spark, d), S)


@query("WITH " + LG + ", i AS (SELECT unnest([2000, 4000, 8000]) AS instant), r AS (SELECT instant, key, kind, seqno, row_number() OVER (PARTITION BY instant, key ORDER BY seqno DESC) AS rn FROM lg JOIN i ON seqno < instant) "
       "SELECT CAST(instant AS BIGINT) AS instant, count(*) AS n_keys, max(seqno) AS max_seqno FROM r WHERE rn=1 AND kind='V' GROUP BY instant")  # fmt: skip
def snapshot_multi(spark, d):
    live = resolve_many(user_log(spark, d), [2000, 4000, 8000], ())
    return live.groupBy("instant").agg(F.count("*").alias("n_keys"), F.max("seqno").alias("max_seqno"))


@query("WITH " + LG + ", r AS (SELECT *, CASE WHEN seqno % 3 = 0 THEN 'a' ELSE 'b' END AS ks FROM lg WHERE seqno < 5000), n AS (SELECT *, row_number() OVER (PARTITION BY ks, key ORDER BY seqno DESC) AS rn FROM r) "
       "SELECT ks, key, value, seqno FROM n WHERE rn=1 AND kind='V'")  # fmt: skip
def snapshot_cross_keyspace(spark, d):
    log = user_log(spark, d).withColumn("ks", F.when(F.col("seqno") % 3 == 0, "a").otherwise("b"))
    return resolve(log, S, by=("ks",))


@query(PAST + "SELECT key, value, seqno FROM snap WHERE key BETWEEN '00000010' AND '00000020'")
def range_incl(spark, d):
    return read.range_(user_log(spark, d), Range("00000010", "00000020", True, True), S)


@query(PAST + "SELECT key, value, seqno FROM snap WHERE key > '00000010' AND key < '00000020'")
def range_excl(spark, d):
    return read.range_(user_log(spark, d), Range("00000010", "00000020", False, False), S)


@query(PAST + "SELECT key, value, seqno FROM snap WHERE key >= '00000100'")
def range_from(spark, d):
    return read.range_(user_log(spark, d), Range("00000100", None), S)


@query(PAST + "SELECT key, value, seqno FROM snap WHERE key < '00000050'")
def range_to(spark, d):
    return read.range_(user_log(spark, d), Range(None, "00000050"), S)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'cold')")
def prefix_scan(spark, d):
    log = Tables(spark, d).part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), F.col("p_partkey").alias("seqno"), F.lit(VALUE).alias("kind"), F.col("p_name").alias("value"))
    return resolve(log.where(F.col("name").startswith("cold"))).select(F.col("key").alias("p_partkey"), F.col("value").alias("p_name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 256 AND o_orderkey < 512")
def prefix_scan_binary(spark, d):
    """Big-endian keys: a prefix of bytes is a range of numbers. Key 00 00 00 00 00 00 01 .. is 256 to 511."""
    log = Tables(spark, d).orders.select(big_endian(F.col("o_orderkey")).alias("key"), F.col("o_orderkey").alias("seqno"), F.lit(VALUE).alias("kind"), F.col("o_custkey").alias("value"))
    return read.prefix(log, bytes(6) + b"\1", columns=()).select(from_big_endian(F.col("key")).alias("o_orderkey"))


@query(PAST + "SELECT row_number() OVER (ORDER BY key DESC) AS pos, key, value FROM snap ORDER BY key DESC LIMIT 10")
def reverse_scan(spark, d):
    return read.with_ordinal(read.top(read.scan(user_log(spark, d), S), 10, reverse=True), reverse=True).select("pos", "key", "value")


@query("WITH base AS (SELECT o_orderkey, o_totalprice AS price, 0 AS s FROM orders WHERE o_orderkey < 10000 UNION ALL SELECT o_orderkey, o_totalprice + 1000, 1 FROM orders WHERE o_orderkey >= 5000) "
       "SELECT o_orderkey, arg_max(price, s) AS price FROM base GROUP BY o_orderkey")  # fmt: skip
def bulk_ingest_merge(spark, d):
    """Two sorted loads that overlap: the later one wins."""
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    loads = as_log(o.where("key < 10000"), seqno=0), as_log(o.where("key >= 5000").withColumn("value", F.col("value") + 1000), seqno=1)
    return write.merge(*loads).select(F.col("key").alias("o_orderkey"), F.col("value").alias("price"))


# --- point reads, projections --------------------------------------------------


@query(PAST + "SELECT key, value, seqno FROM snap WHERE key = '00000042'")
def point_get(spark, d):
    return read.get(user_log(spark, d), "00000042", S)


@query(PAST + "SELECT s.key, value, seqno FROM snap s JOIN customer ON s.key = lpad(CAST(c_custkey AS VARCHAR),8,'0') WHERE c_custkey % 10 = 0")
def multi_get(spark, d):
    return read.multi_get(user_log(spark, d), customers(spark, d).where("c_custkey % 10 = 0"), S)


@query(PAST + "SELECT c_custkey, s.key IS NOT NULL AS present FROM customer LEFT JOIN snap s ON s.key = lpad(CAST(c_custkey AS VARCHAR),8,'0')")
def contains_key(spark, d):
    return read.contains(user_log(spark, d), customers(spark, d), S).select("c_custkey", "present")


@query(PAST + "SELECT c_custkey FROM customer WHERE lpad(CAST(c_custkey AS VARCHAR),8,'0') NOT IN (SELECT key FROM snap)")
def missing_keys(spark, d):
    return read.missing(user_log(spark, d), customers(spark, d), S).select("c_custkey")


def doc_log(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d).documents
    return t.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("seqno"), F.lit(VALUE).alias("kind"), F.col("text").alias("value"), "lang")


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS size FROM documents WHERE lang = 'en'")
def size_of(spark, d):
    """Sizes of the values of one keyspace (language)."""
    t = doc_log(spark, d).where("lang = 'en'").withColumn("size", F.octet_length("value"))
    return resolve(t, columns=("size",)).select(F.col("key").alias("doc_id"), "size")


@query("SELECT doc_id, CAST(strlen(text) AS INTEGER) AS size FROM documents")
def guard_sizes(spark, d):
    """Sizes are taken below the resolution, so texts are not shuffled."""
    t = doc_log(spark, d).withColumn("size", F.octet_length("value"))
    return resolve(t, columns=("size",)).select(F.col("key").alias("doc_id"), "size")


@query(NOW + "SELECT key FROM snap")
def guard_keys(spark, d):
    return read.keys_only(user_log(spark, d))


@query(NOW + "SELECT key, CASE WHEN key < '00000050' THEN value END AS value FROM snap")
def guard_into_inner_if(spark, d):
    return read.values_if(read.scan(user_log(spark, d)), F.col("key") < "00000050")


@query(PAST + "SELECT key, value, seqno FROM snap ORDER BY key LIMIT 1")
def first_key_value(spark, d):
    return read.first(read.scan(user_log(spark, d), S))


@query(PAST + "SELECT key, value, seqno FROM snap ORDER BY key DESC LIMIT 1")
def last_key_value(spark, d):
    return read.last(read.scan(user_log(spark, d), S))


@query(PAST + "SELECT key, value, seqno FROM snap ORDER BY key LIMIT 10")
def top_k_keys(spark, d):
    return read.top(read.scan(user_log(spark, d), S), 10)


@query(NOW + "SELECT key, value, seqno FROM snap WHERE value > 20")
def filter_scan(spark, d):
    return read.scan(user_log(spark, d)).where("value > 20")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def decode_json_value(spark, d):
    e = Tables(spark, d).events.select("event_id", F.from_json("props", "k bigint").alias("r"))
    return e.select("event_id", F.col("r.k").alias("k")).where("k > 50")


# --- aggregates ------------------------------------------------------------------


@query(PAST + "SELECT count(*) AS n FROM snap")
def len_exact(spark, d):
    return read.length(user_log(spark, d), S)


@query("SELECT count(*) AS n FROM events WHERE event_id < 5000")
def approximate_len(spark, d):
    return read.approximate_length(user_log(spark, d), S)


@query(PAST + "SELECT count(*) = 0 AS is_empty FROM snap WHERE key >= '9'")
def is_empty(spark, d):
    return read.is_empty(user_log(spark, d).where("key >= '9'"), S)


@query("SELECT CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000")
def range_sum(spark, d):
    log = as_log(Tables(spark, d).orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), seqno=0)
    return read.total(read.range_(log, Range(1000, 2000, True, True)))


@query("SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, count(*) AS n_entries FROM documents GROUP BY lang")
def keyspace_bytes(spark, d):
    return read.bytes_by(doc_log(spark, d), "lang")


@query("SELECT source, count(*) AS n_keys, min(doc_id) AS first_key, max(doc_id) AS last_key FROM documents GROUP BY source")
def keyspace_stats(spark, d):
    return Tables(spark, d).documents.groupBy("source").agg(F.count("*").alias("n_keys"), F.min("doc_id").alias("first_key"), F.max("doc_id").alias("last_key"))


# --- writes ----------------------------------------------------------------------


def order_items(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))


@query("SELECT coalesce(u.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(u.price, b.price) AS price FROM (SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0) b "
       "FULL OUTER JOIN (SELECT o_orderkey, o_totalprice + 1000 AS price FROM orders WHERE o_orderkey % 2 = 0) u ON b.o_orderkey = u.o_orderkey")  # fmt: skip
def upsert_merge(spark, d):
    o = order_items(spark, d)
    base = write.upserts(o.where("key % 3 <> 0"), 0)
    new = write.upserts(o.where("key % 2 = 0").withColumn("value", F.col("value") + 1000), 1)
    return write.merge(base, new).select(F.col("key").alias("o_orderkey"), F.col("value").alias("price"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_merge(spark, d):
    o = order_items(spark, d)
    building = Tables(spark, d).customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cust"))
    gone = write.deletes(o.join(building, "cust", "left_semi").select("key"), "double", 1)
    return write.merge(write.upserts(o, 0), gone).select(F.col("key").alias("o_orderkey"), F.col("value").alias("price"))


@query("SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F'")
def weak_delete_gc(spark, d):
    o = order_items(spark, d)
    log = write.upserts(o, 0).unionByName(write.deletes(o.where("status = 'F'").select("key"), "double", 1, weak=True))
    return maintain.annihilate_weak(log).select(F.col("key").alias("o_orderkey"), F.col("value").alias("price"))


@query(f"WITH {LG}, late AS (SELECT * FROM lg WHERE seqno > 4900), {snap(S, 'late')} SELECT key, value, seqno FROM snap")
def clear_visibility(spark, d):
    """A clear with the seqno of event 4900 and a later place in its batch: it hides that event too."""
    clear = spark.range(1).select(F.lit(1).cast("long").alias("keyspace_id"), F.lit(None).cast("string").alias("key"), F.lit(4900).cast("long").alias("seqno"), F.lit(1).alias("batch_ord"), F.lit("C").alias("kind"), F.lit(None).cast("double").alias("value"))
    return resolve(drop_cleared(user_log(spark, d).unionByName(clear), S))


@query("WITH " + LG + ", b AS (SELECT key, kind, value, CAST(floor(seqno / 100.0) AS BIGINT) AS commit_id, seqno AS ord FROM lg), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_id DESC, ord DESC) AS rn FROM b WHERE commit_id < 50) "
       "SELECT key, value, commit_id FROM n WHERE rn=1 AND kind='V'")  # fmt: skip
def batch_last_wins(spark, d):
    log = user_log(spark, d).withColumn("batch_ord", F.col("seqno").cast("int")).withColumn("seqno", F.floor(F.col("seqno") / 100))
    return resolve(log, 50).withColumnRenamed("seqno", "commit_id")


def halve_or_drop(v: Column) -> Column:
    """Values over 20 lose 1, values under 5 are deleted, others stay."""
    return F.when(v > 20, v - 1).when(v >= 5, v)


_UPDATED = "SELECT key, value AS prev, CASE WHEN value > 20 THEN value - 1 WHEN value >= 5 THEN value END AS new FROM snap"


@query(PAST + f"SELECT key, prev, new IS DISTINCT FROM prev AS written FROM ({_UPDATED}) u")
def fetch_update(spark, d):
    return write.update(read.scan(user_log(spark, d), S), halve_or_drop).select("key", "prev", "written")


@query(PAST + f"SELECT key, new, new IS DISTINCT FROM prev AS written FROM ({_UPDATED}) u")
def update_fetch(spark, d):
    return write.update(read.scan(user_log(spark, d), S), halve_or_drop).select("key", "new", "written")


@query(PAST + "SELECT key, value FROM snap WHERE key IN (SELECT lpad(CAST(c_custkey AS VARCHAR),8,'0') FROM customer WHERE c_custkey % 7 = 0)")
def take(spark, d):
    return write.take(read.scan(user_log(spark, d), S), customers(spark, d).where("c_custkey % 7 = 0"))


# --- transactions --------------------------------------------------------------------


@query(f"WITH {LG}, {snap(5100)} SELECT key, value, seqno FROM snap")
def ryow_overlay(spark, d):
    log = user_log(spark, d)
    return resolve(overlay(log, log.where("seqno between 5000 and 5099"), S))


@query("WITH " + LG + ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS rn FROM lg WHERE seqno BETWEEN 5000 AND 5099) SELECT key, kind, CASE WHEN kind='V' THEN value END AS value FROM n WHERE rn=1")
def commit_writeset(spark, d):
    return write.write_set(user_log(spark, d).where("seqno between 5000 and 5099"))


@query("WITH w AS (SELECT DISTINCT CAST(floor(event_id / 10.0) AS BIGINT) AS tx, user_id FROM events) SELECT r.tx, count(DISTINCT w.tx) AS n_writers FROM w r JOIN w ON r.user_id = w.user_id AND w.tx < r.tx AND w.tx >= r.tx - 5 GROUP BY r.tx")
def occ_conflicts_point(spark, d):
    sets = Tables(spark, d).events.select(F.floor(F.col("event_id") / 10).alias("tx"), F.col("user_id").alias("key"))
    return transactions.point_conflicts(sets, sets, 5).groupBy("tx").agg(F.count("*").alias("n_writers"))


def range_transactions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    writes = Tables(spark, d).events.select(F.floor(F.col("event_id") / 50).alias("tx"), F.col("user_id").alias("key"))
    return writes.groupBy("tx").agg(F.min("key").alias("lo"), (F.min("key") + 3).alias("hi")), writes


_RANGES = "w AS (SELECT DISTINCT CAST(floor(event_id / 50.0) AS BIGINT) AS tx, user_id FROM events), r AS (SELECT tx, min(user_id) AS lo, min(user_id) + 3 AS hi FROM w GROUP BY tx), c AS (SELECT DISTINCT r.tx, w.tx AS writer FROM r JOIN w ON w.user_id BETWEEN r.lo AND r.hi AND w.tx < r.tx AND w.tx >= r.tx - 3)"


@query(f"WITH {_RANGES} SELECT tx, count(*) AS n_writers FROM c GROUP BY tx")
def occ_conflicts_range(spark, d):
    reads, writes = range_transactions(spark, d)
    return transactions.range_conflicts(reads, writes, 3, 4).groupBy("tx").agg(F.count("*").alias("n_writers"))


_TEXT = "w AS (SELECT DISTINCT CAST(floor(event_id / 50.0) AS BIGINT) AS tx, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events), r AS (SELECT tx, min(key) AS lo, CASE WHEN tx % 4 = 0 THEN NULL ELSE lpad(CAST(CAST(min(key) AS BIGINT) + 2 AS VARCHAR), 8, '0') END AS hi FROM w GROUP BY tx)"


@query(f"WITH {_TEXT}, c AS (SELECT DISTINCT r.tx, w.tx AS writer FROM r JOIN w ON w.key >= r.lo AND (r.hi IS NULL OR w.key <= r.hi) AND w.tx < r.tx AND w.tx >= r.tx - 3) SELECT tx, count(*) AS n_writers FROM c GROUP BY tx")
def occ_conflicts_text_range(spark, d):
    """Ranges of text keys, every fourth of them open above."""
    writes = Tables(spark, d).events.select(F.floor(F.col("event_id") / 50).alias("tx"), user_key("user_id").alias("key"))
    low = writes.groupBy("tx").agg(F.min("key").alias("lo"))
    reads = low.withColumn("hi", F.when(F.col("tx") % 4 != 0, F.lpad((F.col("lo").cast("long") + 2).cast("string"), 8, "0")))
    return transactions.ordered_range_conflicts(reads, writes, 3).groupBy("tx").agg(F.count("*").alias("n_writers"))


@query(f"WITH RECURSIVE {_RANGES}, m AS (SELECT r.tx, CAST(coalesce(bit_or(1 << CAST(r.tx - c.writer - 1 AS INTEGER)), 0) AS INTEGER) AS mask FROM r LEFT JOIN c ON c.tx = r.tx GROUP BY r.tx), "
       "o AS (SELECT min(tx) - 1 AS tx, 0 AS state, false AS ok FROM m UNION ALL "
       "SELECT o.tx + 1, ((o.state << 1) | CASE WHEN m.tx IS NOT NULL AND (o.state & m.mask) = 0 THEN 1 ELSE 0 END) & 7, coalesce((o.state & m.mask) = 0, false) FROM o LEFT JOIN m ON m.tx = o.tx + 1 WHERE o.tx < (SELECT max(tx) FROM m)) "
       "SELECT m.tx, CASE WHEN ok THEN 'ok' ELSE 'conflict' END AS outcome FROM m JOIN o ON o.tx = m.tx")  # fmt: skip
def occ_outcomes(spark, d):
    """Each transaction meets the three commits before it; those that failed do not count as writers."""
    reads, writes = range_transactions(spark, d)
    return transactions.outcomes(reads, transactions.range_conflicts(reads, writes, 3, 4), 3)


# --- maintenance -----------------------------------------------------------------------


@query("WITH " + LG + ", n AS (SELECT *, row_number() OVER (PARTITION BY key, seqno < 5000 ORDER BY seqno DESC) AS rn FROM lg) SELECT key, seqno, kind, value FROM n WHERE seqno >= 5000 OR (rn=1 AND kind='V')")
def compact_gc(spark, d):
    return maintain.compact(user_log(spark, d), S).drop("batch_ord")


@query(f"WITH {LG}, {snap(7000)} SELECT key, value, seqno FROM snap")
def compact_equivalence(spark, d):
    """A read above the watermark over the compacted log."""
    return resolve(maintain.compact(user_log(spark, d), S), 7000)


@query("SELECT min(event_id) - 1 AS watermark, count(*) AS n_leases FROM events WHERE event_id > 100 AND event_type = 'purchase'")
def gc_watermark(spark, d):
    leases = Tables(spark, d).events.where("event_id > 100 and event_type = 'purchase'")
    return maintain.watermark(leases.select(F.col("event_id").alias("instant")))


@query("SELECT doc_id FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id DESC) AS s FROM documents) t WHERE s <= 200000")
def fifo_size_limit(spark, d):
    return maintain.fifo_by_size(Tables(spark, d).documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000).select("doc_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def fifo_ttl(spark, d):
    return maintain.fifo_by_age(Tables(spark, d).events.select("event_id", "ts"), "ts", "7 DAY").select("event_id")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'hot') OR p_partkey % 2 = 1")
def compaction_filter_prefix(spark, d):
    """One of two keyspaces (even and odd keys) has a filter that keeps a prefix; the other is left alone."""
    p = Tables(spark, d).part.select("p_partkey", "p_name")
    verdict = F.when((F.col("p_partkey") % 2 == 0) & ~F.col("p_name").startswith("hot"), maintain.REMOVE)
    return maintain.apply_filter(p, verdict)


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'MIGRATED' ELSE p_type END AS p_type FROM part WHERE p_size <= 40")
def compaction_filter_replace(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_type", "p_size")
    verdict = F.when(F.col("p_size") > 40, maintain.REMOVE).when(F.col("p_type") == "PROMO", maintain.REPLACE)
    return maintain.apply_filter(p, verdict, F.lit("MIGRATED"), "p_type").drop("p_size")


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL OR CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def ttl_expire(spark, d):
    return maintain.expire(Tables(spark, d).events, F.from_json("props", "k bigint")["k"], 50).select("event_id")


_OLD = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT event_id, CASE WHEN {_OLD} % 2 = 0 THEN concat('v2:', {_OLD}) ELSE props END AS value FROM events")
def migrate_lazy(spark, d):
    """Values of the old form (even k) are rewritten; what does not decode to it stays."""
    e = Tables(spark, d).events.select("event_id", F.col("props").alias("value"))
    k = F.from_json("value", "k bigint")["k"]
    return maintain.apply_filter(e, F.when(k % 2 == 0, maintain.REPLACE), F.concat(F.lit("v2:"), k.cast("string")))


@query(f"SELECT event_id, {_OLD} * 10 AS k FROM events")
def migrate_eager(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", (F.from_json("props", "k bigint")["k"] * 10).alias("k"))


@query("SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY l_orderkey HAVING count(*) = max(l_linenumber)")
def torn_batch_discard(spark, d):
    return maintain.complete_batches(Tables(spark, d).lineitem, "l_orderkey", F.col("l_linenumber"))


@query("WITH " + LG + ", b AS (SELECT CAST(floor(seqno / 7.0) AS BIGINT) AS batch FROM lg GROUP BY 1 HAVING count(*) = 7), r AS (SELECT lg.* FROM lg JOIN b ON CAST(floor(seqno / 7.0) AS BIGINT) = b.batch), " + snap(None, "r") + " SELECT key, value, seqno FROM snap")
def journal_replay(spark, d):
    """State after replaying the whole batches of seven events; a torn last batch is left out."""
    log = user_log(spark, d).withColumn("batch", F.floor(F.col("seqno") / 7))
    whole = maintain.complete_batches(log, "batch", F.lit(7))
    return resolve(log.join(whole, "batch", "left_semi"))


@query("SELECT max(event_id) + 1 AS next_seqno FROM events WHERE CAST(floor(event_id / 7.0) AS BIGINT) IN (SELECT CAST(floor(event_id / 7.0) AS BIGINT) FROM events GROUP BY 1 HAVING count(*) = 7)")
def recover_seqno(spark, d):
    log = user_log(spark, d).withColumn("batch", F.floor(F.col("seqno") / 7))
    whole = log.groupBy("batch").agg(F.count("*").alias("n"), F.max("seqno").alias("s")).where("n = 7")
    return whole.agg((F.max("s") + 1).alias("next_seqno"))


@query("SELECT doc_id, sha256(text) AS sha, CAST(strlen(text) AS INTEGER) AS size FROM documents WHERE strlen(text) >= 2000")
def blob_separation(spark, d):
    """Large values by content address beside the keys, and found again through it."""
    items, blobs = maintain.separate_blobs(doc_log(spark, d).select("key", "value"), 2000)
    back = items.join(blobs.select("sha", F.octet_length("value").alias("stored")), "sha")
    return back.where("stored = size").select(F.col("key").alias("doc_id"), "sha", "size")


# --- index patterns -----------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def secondary_index_range(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("key"), "o_totalprice", "o_orderdate")
    entries = index.secondary(o, F.col("o_orderdate"))
    within = (F.col("index_key") >= F.expr("TIMESTAMP_NTZ '1995-01-01'")) & (F.col("index_key") < F.expr("TIMESTAMP_NTZ '1996-01-01'"))
    return index.lookup(entries, o.drop("o_orderdate"), within).select(F.col("key").alias("o_orderkey"), "o_totalprice")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) t WHERE rn > 1")
def unique_violations(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("key"), "p_name")
    return index.unique_violations(p, "p_name").select(F.col("key").alias("p_partkey"), "p_name")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%widget'")
def suffix_search(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("key"), "p_name")
    return index.suffix(index.reversed_index(p, "p_name"), "widget").select(F.col("key").alias("p_partkey"))


def types_index(spark: SparkSession, d: str) -> DataFrame:
    return index.permuterm(Tables(spark, d).part.select(F.col("p_partkey").alias("key"), "p_type"), "p_type")


for _name, _pattern, _like in (("exact", "PROMO", "= 'PROMO'"), ("prefix", "S*", "LIKE 'S%'"), ("suffix", "*RD", "LIKE '%RD'"), ("partial", "*AN*", "LIKE '%AN%'"), ("between", "S*D", "LIKE 'S%D'")):

    def _wildcard(spark, d, pattern=_pattern):
        return index.wildcard(types_index(spark, d), pattern).select(F.col("key").alias("p_partkey"))

    _wildcard.__name__ = f"permuterm_{_name}"
    query(f"SELECT p_partkey FROM part WHERE p_type {_like}")(_wildcard)


def triples(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    lives = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("s"), F.lit("lives_in").alias("v"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("o"))
    part_of = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("s"), F.lit("part_of").alias("v"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("o"))
    return lives.unionByName(part_of)


@query("SELECT concat('n', c_nationkey) AS o FROM customer WHERE c_custkey = 42")
def triples_out(spark, d):
    return index.out_edges(triples(spark, d), "c42", "lives_in")


@query("SELECT concat('c', c_custkey) AS s, concat('n', n_nationkey) AS mid, concat('r', n_regionkey) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def triples_two_hop(spark, d):
    return index.two_hops(triples(spark, d), "lives_in", "part_of")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def queue_dequeue(spark, d):
    open_ = order_items(spark, d).where("status = 'O'").select("key")
    return index.dequeue(open_, 100).select(F.col("key").alias("o_orderkey"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'todo' END AS keyspace, o_orderkey FROM orders")
def keyspace_move(spark, d):
    moved = write.move(order_items(spark, d), F.col("status") == "F", "todo", "done")
    return moved.select("keyspace", F.col("key").alias("o_orderkey"))


@query("SELECT user_id, least(count(*), 60) AS n FROM events GROUP BY user_id")
def atomic_counter(spark, d):
    return write.counters(Tables(spark, d).events.select(F.col("user_id").alias("key")), 60).select(F.col("key").alias("user_id"), F.col("value").alias("n"))


@query("SELECT sha256(text) AS sha, count(*) AS refs FROM documents GROUP BY 1")
def cas_refcount(spark, d):
    return index.content_refs(doc_log(spark, d)).select("sha", "refs")


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_key FROM documents GROUP BY 1")
def cas_dedupe(spark, d):
    return index.content_refs(doc_log(spark, d)).select("sha", "first_key")


@query("SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def structured_records(spark, d):
    """Typed records under a compound key: one scan of each conversation's prefix."""
    c = Tables(spark, d).conversations.select(F.struct("conv_id", "turn").alias("key"), F.struct("role", "text").alias("value"))
    return c.groupBy(F.col("key.conv_id").alias("conv_id")).agg(F.count("*").alias("n_turns"), F.max("key.turn").alias("last_turn"))
