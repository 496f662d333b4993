"""Maintenance: version collection, retention, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.model import CLEAR, VALUE
from keystrand.operators.resolve import drop_cleared

KEEP, REMOVE, REPLACE = "keep", "remove", "replace"


def compact(log: DataFrame, watermark: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that some reader at an instant >= watermark can see: (by, key, seqno, batch_ord, kind, value).

    Rows from the watermark on stay as they are, clears and places in a batch included, without a
    shuffle; below it only the newest row of a key that no clear below it hides stays, unless it is a
    tombstone.  A log with clears must have keyspace_id.
    """
    log = log if "batch_ord" in log.columns else log.withColumn("batch_ord", F.lit(0))
    columns = (*by, "key", "seqno", "batch_ord", "kind", "value")
    above = log.where(F.col("seqno") >= watermark).select(*columns)
    old = drop_cleared(log, watermark) if "keyspace_id" in log.columns else log.where(F.col("seqno") < watermark)
    best = old.groupBy(*by, "key").agg(F.max(F.struct("seqno", "batch_ord", "kind", "value")).alias("m"))
    return above.unionByName(best.where(F.col("m.kind") == VALUE).select(*by, "key", "m.*"))


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each key that no clear hides, tombstones too, and the newest clear: enough to go on from with later rows."""
    clears = log.where(F.col("kind") == CLEAR).orderBy(F.desc("seqno"), F.desc("batch_ord")).limit(1)
    rows = drop_cleared(log.withColumn("keyspace_id", F.lit(0)))
    best = rows.groupBy("key").agg(F.max(F.struct("seqno", "batch_ord", "kind", "value")).alias("m")).select("key", "m.*")
    return best.unionByName(clears.select(*best.columns))


def annihilate_weak(log: DataFrame) -> DataFrame:
    """(key, value, seqno) of values that no weak tombstone cancels.

    A weak tombstone cancels the one value written before it; a value that is written after it stays.
    So a key is live if its newest row is a value, which is what the newest row says of any log.
    """
    log = log if "batch_ord" in log.columns else log.withColumn("batch_ord", F.lit(0))
    last = log.groupBy("key").agg(F.max(F.struct("seqno", "batch_ord", "kind", "value")).alias("m"))
    return last.where(F.col("m.kind") == VALUE).select("key", F.col("m.value").alias("value"), F.col("m.seqno").alias("seqno"))


def watermark(leases: DataFrame) -> DataFrame:
    """The instant below which versions may be collected, from the live leases (instant)."""
    return leases.agg((F.min("instant") - 1).alias("watermark"), F.count("*").alias("n_leases"))


def fifo_by_size(items: DataFrame, order: str, size: str, limit: int, cells: int = 4096) -> DataFrame:
    """The most recent items (order descending) whose running size stays within the limit.

    The running sum has two levels: totals of at most `cells` ranges of the order column, which are
    few and are summed up and broadcast, and sums inside the ranges that the limit leaves open.
    """
    ends = items.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    cell = F.floor((F.col("hi") - F.col(order)) * cells / (F.col("hi") - F.col("lo") + 1)).cast("int")
    placed = items.join(F.broadcast(ends)).withColumn("_cell", cell).drop("lo", "hi")
    totals = placed.groupBy("_cell").agg(F.sum(size).alias("_sum"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < limit)
    open_ = placed.join(F.broadcast(before.select("_cell", "_before")), "_cell")
    run = F.col("_before") + F.sum(size).over(Window.partitionBy("_cell").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return open_.withColumn("_run", run).where(F.col("_run") <= limit).drop("_cell", "_before", "_run")


def fifo_by_age(items: DataFrame, ts: str, keep: str) -> DataFrame:
    """Items no older than an interval before the newest one. The newest time is one value."""
    newest_ts = items.agg(F.max(ts).alias("_newest"))
    return items.join(F.broadcast(newest_ts)).where(F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {keep}")).drop("_newest")


def apply_filter(items: DataFrame, verdict: Column, replacement: Column | None = None, column: str = "value") -> DataFrame:
    """A compaction filter: verdict is keep, remove or replace for each item; a null verdict keeps."""
    kept = items.where(F.coalesce(verdict, F.lit(KEEP)) != REMOVE)
    return kept if replacement is None else kept.withColumn(column, F.when(verdict == REPLACE, replacement).otherwise(F.col(column)))


def expire(items: DataFrame, ttl: Column, now: int) -> DataFrame:
    """Items whose decoded time to live lies above `now`; what cannot be decoded stays."""
    return items.where(ttl.isNull() | (ttl > now))


def complete_batches(items: DataFrame, batch: str, expected: Column) -> DataFrame:
    """(batch, n_items) of batches whose items are as many as the header says; torn ones are discarded."""
    return items.groupBy(batch).agg(F.count("*").alias("n_items"), F.max(expected).alias("_expected")).where("n_items = _expected").drop("_expected")


def separate_blobs(items: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items with sha and size instead of values, blobs by sha once each); join them on sha."""
    named = items.withColumn("sha", F.sha2(F.col("value"), 256)).withColumn("size", F.octet_length("value"))
    big = named.where(F.col("size") >= least)
    return named.drop("value"), big.select("sha", "value").dropDuplicates(["sha"])
