"""Writes as DataFrames of log rows; a commit appends them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.model import TOMBSTONE, VALUE, WEAK, as_log
from keystrand.operators.resolve import newest, resolve


def upserts(items: DataFrame, seqno: int | Column | None = None, **at) -> DataFrame:
    return as_log(items, VALUE, seqno, **at)


def deletes(keys: DataFrame, value_type: str, seqno: int | Column | None = None, weak: bool = False, **at) -> DataFrame:
    """Tombstones, also for keys that do not exist."""
    return as_log(keys.withColumn("value", F.lit(None).cast(value_type)), WEAK if weak else TOMBSTONE, seqno, **at)


def merge(*logs: DataFrame) -> DataFrame:
    """The live items after all logs."""
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x)
    return resolve(out)


def update(items: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Read-modify-write of live items: key, prev, new, written.

    change maps the value to a new one, null deletes.  An unchanged value is not written.
    """
    changed = items.select("key", F.col("value").alias("prev"), change(F.col("value")).alias("new"))
    return changed.withColumn("written", ~F.col("prev").eqNullSafe(F.col("new")))


def update_keys(items: DataFrame, keys: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """As update, for given keys, whether or not they exist (prev is then null)."""
    return update(keys.select("key").distinct().join(items.select("key", "value"), "key", "left"), change)


def update_rows(updates: DataFrame, seqno: int, **at) -> DataFrame:
    """Log rows of an update: values, or tombstones where `new` is null."""
    rows = updates.where("written").select("key", F.col("new").alias("value"))
    return as_log(rows, F.when(F.col("value").isNull(), TOMBSTONE).otherwise(VALUE), seqno, **at)


def take(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Old values of the keys that exist; remove them with deletes()."""
    return items.join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")


def write_set(rows: DataFrame) -> DataFrame:
    """What a transaction commits: its newest row of each key, tombstones included."""
    return newest(rows).select("key", "kind", F.when(F.col("kind") == VALUE, F.col("value")).alias("value"))


def counters(events: DataFrame, limit: int) -> DataFrame:
    """Counts by key, summed up as one delta each and held at a limit."""
    return events.groupBy("key").agg(F.least(F.lit(limit).cast("long"), F.count("*")).alias("value"))


def move(items: DataFrame, moved: Column, source: str, target: str) -> DataFrame:
    """(keyspace, key) after the items for which `moved` holds went from one keyspace to another in one commit."""
    return items.select(F.when(moved, F.lit(target)).otherwise(F.lit(source)).alias("keyspace"), "key")
