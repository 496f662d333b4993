"""Snapshot resolution: the only place that knows about versions.

The newest row of each key below the instant wins; the key is live if that row
is a value.  One shuffle on the key, with partial aggregation before it: the
running maximum of a struct (seqno, batch_ord, kind, requested columns).  Key
predicates given before or after pass through the grouping into the scan;
columns that are not asked for are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.model import CLEAR, VALUE


def visible(log: DataFrame, instant: int | Column | None) -> DataFrame:
    return log if instant is None else log.where(F.col("seqno") < instant)


def newest(log: DataFrame, instant: int | None = None, columns: Sequence[str] = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """The newest row of each key, tombstones included: by, key, columns, seqno, kind."""
    rows = visible(log, instant)
    if "batch_ord" not in rows.columns:
        rows = rows.withColumn("batch_ord", F.lit(0))
    best = rows.groupBy(*by, "key").agg(F.max(F.struct("seqno", "batch_ord", "kind", *columns)).alias("m"))
    return best.select(*by, "key", *(F.col(f"m.{c}").alias(c) for c in columns), F.col("m.seqno").alias("seqno"), F.col("m.kind").alias("kind"))


def resolve(log: DataFrame, instant: int | None = None, columns: Sequence[str] = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """Live items at an instant: by, key, columns, seqno."""
    return newest(log, instant, columns, by).where(F.col("kind") == VALUE).drop("kind")


def resolve_many(log: DataFrame, instants: Sequence[int], columns: Sequence[str] = ("value",)) -> DataFrame:
    """Live items at several instants in one pass and one shuffle: instant, key, columns, seqno."""
    if "batch_ord" not in log.columns:
        log = log.withColumn("batch_ord", F.lit(0))
    row = F.struct("seqno", "batch_ord", "kind", *columns)
    rows = log.where(F.col("seqno") < max(instants))
    best = rows.groupBy("key").agg(*(F.max(F.when(F.col("seqno") < i, row)).alias(f"m{i}") for i in instants))
    each = best.select("key", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("instant"), F.col(f"m{i}").alias("m")) for i in instants))).alias("x"))
    live = each.where(F.col("x.m.kind") == VALUE)
    return live.select(F.col("x.instant").alias("instant"), "key", *(F.col(f"x.m.{c}").alias(c) for c in columns), F.col("x.m.seqno").alias("seqno"))


def drop_cleared(log: DataFrame, instant: int | None = None) -> DataFrame:
    """Rows that no clear of their keyspace before the instant hides; clears themselves go.

    The clears, one row for each keyspace, are few by nature (keyspaces are catalogue entries).
    """
    rows = visible(log, instant)
    last = rows.where(F.col("kind") == CLEAR).groupBy("keyspace_id").agg(F.max(F.struct("seqno", "batch_ord")).alias("cleared"))
    kept = rows.where(F.col("kind") != CLEAR).join(last, "keyspace_id", "left")
    return kept.where(F.col("cleared").isNull() | (F.struct("seqno", "batch_ord") > F.col("cleared"))).drop("cleared")


def overlay(base: DataFrame, writes: DataFrame, instant: int | None = None) -> DataFrame:
    """Read-your-own-writes: a base at an instant under a transaction's own rows (whose seqnos are above)."""
    return visible(base, instant).unionByName(writes)
