"""Reads of a keyspace at an instant.

Key predicates stand below the resolution, so they reach the Parquet scan;
value predicates stand above it, as only the newest value of a key counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.model import Range, starts_with
from keystrand.operators.resolve import resolve, visible

Names = Sequence[str]


def scan(log: DataFrame, instant: int | None = None, columns: Names = ("value",)) -> DataFrame:
    return resolve(log, instant, columns)


def get(log: DataFrame, key, instant: int | None = None, columns: Names = ("value",)) -> DataFrame:
    return resolve(log.where(F.col("key") == F.lit(key)), instant, columns)


def multi_get(log: DataFrame, keys: DataFrame, instant: int | None = None, columns: Names = ("value",)) -> DataFrame:
    """Items of the keys in a DataFrame (key); absent keys are left out. The semi join is below the resolution."""
    return resolve(log.join(keys.select("key").distinct(), "key", "left_semi"), instant, columns)


def contains(log: DataFrame, keys: DataFrame, instant: int | None = None) -> DataFrame:
    """keys with a column `present`. Only rows of these keys are resolved."""
    live = multi_get(log, keys, instant, ()).select("key", F.lit(True).alias("present"))
    return keys.join(live, "key", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def missing(log: DataFrame, keys: DataFrame, instant: int | None = None) -> DataFrame:
    return keys.join(multi_get(log, keys, instant, ()).select("key"), "key", "left_anti")


def range_(log: DataFrame, bounds: Range, instant: int | None = None, columns: Names = ("value",)) -> DataFrame:
    return resolve(log.where(bounds.holds(F.col("key"))), instant, columns)


def prefix(log: DataFrame, start: str | bytes, instant: int | None = None, columns: Names = ("value",)) -> DataFrame:
    return resolve(log.where(starts_with(F.col("key"), start)) if start else log, instant, columns)


def ordered(items: DataFrame, reverse: bool = False) -> DataFrame:
    return items.orderBy(F.desc("key") if reverse else F.asc("key"))


def top(items: DataFrame, k: int, reverse: bool = False) -> DataFrame:
    """The first (reverse: last) k items: a bounded heap in each task."""
    return ordered(items, reverse).limit(k)


def first(items: DataFrame) -> DataFrame:
    return top(items, 1)


def last(items: DataFrame) -> DataFrame:
    return top(items, 1, reverse=True)


def with_ordinal(few: DataFrame, reverse: bool = False) -> DataFrame:
    """Numbers the rows of a bounded result (of top) in key order, from 1."""
    from pyspark.sql import Window

    return few.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("key") if reverse else F.asc("key"))).cast("long"))


def length(log: DataFrame, instant: int | None = None) -> DataFrame:
    return resolve(log, instant, ()).agg(F.count("*").alias("n"))


def approximate_length(log: DataFrame, instant: int | None = None) -> DataFrame:
    """Versions, tombstones included: no shuffle but that of one number."""
    return visible(log, instant).agg(F.count("*").alias("n"))


def is_empty(log: DataFrame, instant: int | None = None) -> DataFrame:
    return resolve(log, instant, ()).limit(1).agg((F.count("*") == 0).alias("is_empty"))


def sizes(items: DataFrame) -> DataFrame:
    return items.select("key", F.octet_length("value").alias("size"))


def keys_only(log: DataFrame, instant: int | None = None) -> DataFrame:
    """Keys of live items; the value column is not read."""
    return resolve(log, instant, ()).select("key")


def values_if(items: DataFrame, keep: Column) -> DataFrame:
    """All keys, with values only where the key predicate holds."""
    return items.select("key", F.when(keep, F.col("value")).alias("value"))


def total(items: DataFrame, column: str = "value") -> DataFrame:
    return items.agg(F.sum(column).alias("total"))


def bytes_by(log: DataFrame, by: str, column: str = "value") -> DataFrame:
    return log.groupBy(by).agg(F.sum(F.octet_length(column)).alias("n_bytes"), F.count("*").alias("n_entries"))
