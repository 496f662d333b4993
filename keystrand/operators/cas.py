"""A content-addressed store on three keyspaces: links (key to address), counts (address to references), blobs (address to value).

Each change is one commit over all three, made of joins; an address whose last
reference goes loses its count and its blob in the same commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.operators import read


class ContentStore:
    def __init__(self, db, name: str, key: str = "string"):
        self.db = db
        self.links = db.keyspace(f"{name}/links", key=key, value="string")
        self.counts = db.keyspace(f"{name}/counts", key="string", value="long")
        self.blobs = db.keyspace(f"{name}/blobs", key="string", value="string")

    def put(self, items: DataFrame) -> int | None:
        """Sets items (key, value), each key once; keys that exist let go of what they referred to."""
        named = items.select("key", F.sha2("value", 256).alias("sha"), "value")
        old = read.multi_get(self.links.log(), named.select("key")).select(F.col("value").alias("sha"))
        batch = self._count(named.select("sha"), old)
        known = read.scan(self.blobs.log(), columns=()).select(F.col("key").alias("sha"))
        new = named.join(known, "sha", "left_anti").groupBy(F.col("sha").alias("key")).agg(F.first("value").alias("value"))
        batch.insert_all(self.links, named.select("key", F.col("sha").alias("value"))).insert_all(self.blobs, new)
        return batch.commit()

    def remove(self, keys: DataFrame) -> int | None:
        """Removes the keys of (key) that exist."""
        gone = read.multi_get(self.links.log(), keys)
        batch = self._count(None, gone.select(F.col("value").alias("sha")))
        return batch.remove_all(self.links, gone.select("key")).commit()

    def _count(self, more: DataFrame | None, fewer: DataFrame):
        """A batch with the new counts; blobs without references go."""
        change = fewer.select("sha", F.lit(-1).alias("by"))
        if more is not None:
            change = change.unionByName(more.select("sha", F.lit(1).alias("by")))
        change = change.groupBy(F.col("sha").alias("key")).agg(F.sum("by").alias("by")).where("by <> 0")
        after = change.join(read.multi_get(self.counts.log(), change.select("key")).select("key", "value"), "key", "left").select("key", (F.coalesce("value", F.lit(0)) + F.col("by")).alias("value"))
        gone = after.where("value <= 0").select("key")
        return self.db.batch().insert_all(self.counts, after.where("value > 0")).remove_all(self.counts, gone).remove_all(self.blobs, gone)

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the keys that exist."""
        links = read.multi_get(self.links.log(), keys).select("key", F.col("value").alias("sha"))
        return links.join(read.scan(self.blobs.log()).select(F.col("key").alias("sha"), "value"), "sha").select("key", "value")
