"""Optimistic concurrency as joins between read sets and write sets.

A transaction conflicts if a commit between its start and its own commit wrote
a key that it read.  Writing the same key is no conflict by itself.  Reads are
points or ranges of any ordered keys; scans, first and last read the whole keyspace, and asking for
a size reads nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_conflicts(reads: DataFrame, writes: DataFrame, window: int) -> DataFrame:
    """(tx, writer) for reads(tx, key) and writes(tx, key) of commits numbered tx; a transaction starts `window` commits before its own.

    The band of commits becomes an equality on buckets of `window` commits, of which a read meets two.
    """
    r = reads.select("tx", "key").distinct().withColumn("bucket", F.explode(F.array(F.floor(F.col("tx") / window), F.floor(F.col("tx") / window) - 1)))
    w = writes.select(F.col("tx").alias("writer"), "key").distinct().withColumn("bucket", F.floor(F.col("writer") / window))
    hit = r.join(w, ["key", "bucket"]).where((F.col("writer") < F.col("tx")) & (F.col("writer") >= F.col("tx") - window))
    return hit.select("tx", "writer").distinct()


def range_conflicts(reads: DataFrame, writes: DataFrame, window: int, width: int) -> DataFrame:
    """(tx, writer) for reads(tx, lo, hi) over integer keys, both bounds included.

    Ranges are cut at multiples of `width` keys, so that the range join is an equi-join on
    (cell, bucket); a range covers few cells when width is about its size.
    """
    r = reads.select("tx", "lo", "hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    r = r.withColumn("bucket", F.explode(F.array(F.floor(F.col("tx") / window), F.floor(F.col("tx") / window) - 1)))
    w = writes.select(F.col("tx").alias("writer"), "key").distinct().withColumn("cell", F.floor(F.col("key") / width)).withColumn("bucket", F.floor(F.col("writer") / window))
    hit = r.join(w, ["cell", "bucket"]).where("key between lo and hi and writer < tx").where(F.col("writer") >= F.col("tx") - window)
    return hit.select("tx", "writer").distinct()


def ordered_range_conflicts(reads: DataFrame, writes: DataFrame, window: int, cells: int = 64, sample: int = 4096) -> DataFrame:
    """(tx, writer) for reads(tx, lo, hi) over keys of any ordered type; a null bound is open, both others are included.

    The cells of the equi-join lie between quantiles of a bounded sample of the written keys (those of
    least hash), so that they hold about as many writes each; the bounds are few and part of the plan.
    """
    seen = sorted(r["key"] for r in writes.select("key").where("key is not null").distinct().orderBy(F.xxhash64("key")).limit(sample).collect())
    bounds = sorted({seen[len(seen) * k // cells] for k in range(1, cells)}) if seen else []
    edges = F.array(*map(F.lit, bounds)) if bounds else None
    cell = lambda key: F.size(F.filter(edges, lambda e: e <= key)) if bounds else F.lit(0)
    first, last = F.when(F.col("lo").isNull(), 0).otherwise(cell(F.col("lo"))), F.when(F.col("hi").isNull(), len(bounds)).otherwise(cell(F.col("hi")))
    r = reads.where(F.coalesce(F.col("lo") <= F.col("hi"), F.lit(True))).withColumn("cell", F.explode(F.sequence(first, last)))
    r = r.withColumn("bucket", F.explode(F.array(F.floor(F.col("tx") / window), F.floor(F.col("tx") / window) - 1)))
    w = writes.select(F.col("tx").alias("writer"), "key").distinct().withColumn("cell", cell(F.col("key"))).withColumn("bucket", F.floor(F.col("writer") / window))
    inside = F.coalesce(F.col("key") >= F.col("lo"), F.lit(True)) & F.coalesce(F.col("key") <= F.col("hi"), F.lit(True))
    hit = r.join(w, ["cell", "bucket"]).where(inside & (F.col("writer") < F.col("tx")) & (F.col("writer") >= F.col("tx") - window))
    return hit.select("tx", "writer").distinct()


def outcomes(txs: DataFrame, conflicts: DataFrame, window: int, chunk: int = 1024) -> DataFrame:
    """(tx, outcome) in commit order: a transaction fails only if a writer it meets has committed; one that fails writes nothing.

    conflicts: (tx, writer), writer being one of the `window` (at most 16) commits before.  What a
    transaction must know is which of those committed, one of 2 ** window states; so each chunk of
    commits is a function from the state before it to the state after it.  The functions are
    computed side by side, composed in order (one row for each chunk), and each chunk is then
    gone through once more from its true state.
    """
    full = (1 << window) - 1
    mask = conflicts.select("tx", "writer").distinct().groupBy("tx").agg(F.expr("bit_or(shiftleft(1, cast(tx - writer - 1 as int)))").alias("mask"))
    met = txs.select("tx").distinct().join(mask, "tx", "left").select(F.floor(F.col("tx") / chunk).alias("c"), F.struct(F.col("tx").cast("long").alias("tx"), F.coalesce("mask", F.lit(0)).alias("mask")).alias("x"))
    chunks = met.groupBy("c").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def later(state: Column, gap: Column) -> Column:
        """The state when `gap` commit numbers more have passed without a commit."""
        return F.when(gap >= window, F.lit(0)).otherwise(F.call_function("shiftleft", state, gap.cast("int")).bitwiseAND(F.lit(full)))

    def after(a: Column, x: Column) -> Column:
        now = later(a["state"], x["tx"] - a["last"] - 1)
        ok = F.when(now.bitwiseAND(x["mask"]) == 0, 1).otherwise(0)
        return F.struct(F.call_function("shiftleft", now, F.lit(1)).bitwiseOR(ok).bitwiseAND(F.lit(full)).alias("state"), x["tx"].alias("last"))

    begin = lambda state: F.struct(state.cast("int").alias("state"), (F.col("c") * chunk - 1).alias("last"))
    end = lambda a: later(a["state"], (F.col("c") + 1) * chunk - 1 - a["last"])
    maps = chunks.select("c", F.array(*(F.aggregate("xs", begin(F.lit(s)), after, end) for s in range(full + 1))).alias("m")).orderBy("c")
    rows, state, last = [], 0, None
    for r in maps.toLocalIterator():
        state = state if last is not None and r["c"] == last + 1 else 0
        rows.append((r["c"], state))
        state, last = r["m"][state], r["c"]
    starts = txs.sparkSession.createDataFrame(rows, "c long, state int")
    none = F.array().cast("array<struct<tx:bigint,ok:boolean>>")

    def judged(a: Column, x: Column) -> Column:
        now = after(a["a"], x)
        return F.struct(now.alias("a"), F.concat(a["out"], F.array(F.struct(x["tx"].alias("tx"), (now["state"].bitwiseAND(F.lit(1)) == 1).alias("ok")))).alias("out"))

    out = chunks.join(starts, "c").select(F.explode(F.aggregate("xs", F.struct(begin(F.col("state")).alias("a"), none.alias("out")), judged, lambda a: a["out"])).alias("o"))
    return out.select("o.tx", F.when(F.col("o.ok"), "ok").otherwise("conflict").alias("outcome"))
