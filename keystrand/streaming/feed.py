"""Change feeds: committed rows as micro-batches, and state kept up to date from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.model import VALUE
from keystrand.operators.maintain import latest
from keystrand.sources.store import Files, Keyspace

_COMMIT = "files array<struct<keyspace:long,path:string>>"


def follow(ks: Keyspace, handle: Callable[[DataFrame, int], None], checkpoint: str, commits_per_trigger: int = 100):
    """Streams the manifest and gives handle(rows, batch) the log rows of the commits in each micro-batch, in order of commits.

    Only files that a commit names are read, each once: drafts, broken-off writes and compacted files
    are no changes.  Files must not be vacuumed before they were followed.  A micro-batch that is
    repeated after a failure has the same number and rows.
    """
    spark = ks.db.spark

    def batch(entries: DataFrame, n: int) -> None:
        files = entries.select(F.explode(F.from_json("value", _COMMIT)["files"]).alias("f")).where(F.col("f.keyspace") == ks.id)
        paths = sorted(f"{ks.db.root}/{r['path']}" for r in files.select("f.path").collect())  # at most commits_per_trigger
        if paths:
            handle(spark.read.schema(ks.schema).parquet(*paths), n)

    entries = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", commits_per_trigger).text(f"{ks.db.root}/manifest")
    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_state(ks: Keyspace, checkpoint: str, commits_per_trigger: int = 100) -> DataFrame:
    """Follows the keyspace to its present end and returns its live items, from a table that is kept beside the checkpoint.

    Each micro-batch is merged with the table of the one before, clears included, so a later call goes on from there.
    """
    spark, files = ks.db.spark, Files(ks.db.spark, checkpoint)
    made = lambda: [int(x) for x in files.list("state") if files.exists(f"state/{x}/_SUCCESS")]

    def merge(rows: DataFrame, n: int) -> None:
        before = max((k for k in made() if k < n), default=None)
        if before is not None:
            rows = spark.read.schema(ks.schema).parquet(f"{checkpoint}/state/{before}").unionByName(rows)
        latest(rows).write.mode("overwrite").parquet(f"{checkpoint}/state/{n}")
        for k in made():
            if before is not None and k < before:
                files.delete(f"state/{k}")

    follow(ks, merge, f"{checkpoint}/feed", commits_per_trigger).awaitTermination()
    last = max(made(), default=None)
    rows = spark.createDataFrame([], ks.schema) if last is None else spark.read.schema(ks.schema).parquet(f"{checkpoint}/state/{last}")
    return live(rows)


def state(feed: DataFrame) -> DataFrame:
    """The newest row of each key of a stream of log rows, as a streaming aggregate; live items have kind V."""
    newest = feed.groupBy("key").agg(F.max(F.struct("seqno", "batch_ord", "kind", "value")).alias("m"))
    return newest.select("key", F.col("m.value").alias("value"), F.col("m.seqno").alias("seqno"), F.col("m.kind").alias("kind"))


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == VALUE).select("key", "value", "seqno")


def late_counts(feed: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """Commits in event-time windows, with a bound on lateness so that state is dropped."""
    return feed.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
