"""Index patterns: secondary, unique, suffix, wildcard, graph, queue, content addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "$"  # ends a term in a permuterm index


def secondary(items: DataFrame, index_key: Column) -> DataFrame:
    """An index keyspace: (index_key, key); sort it by index_key when it is written."""
    return items.select(index_key.alias("index_key"), "key")


def lookup(index: DataFrame, items: DataFrame, where: Column) -> DataFrame:
    """Items whose index entry satisfies a predicate; the predicate reaches the index scan."""
    return items.join(index.where(where), "key")


def unique_violations(items: DataFrame, unique: str) -> DataFrame:
    """Items that an insert in key order would have rejected: those after the first of their unique value."""
    first = items.groupBy(unique).agg(F.min("key").alias("_first"))
    return items.join(first, unique).where(F.col("key") > F.col("_first")).drop("_first")


def reversed_index(items: DataFrame, term: str) -> DataFrame:
    """(rev, key): a suffix search is a prefix search on the stored reversal."""
    return items.select(F.reverse(term).alias("rev"), "key")


def suffix(index: DataFrame, end: str) -> DataFrame:
    return index.where(F.col("rev").startswith(end[::-1])).select("key")


def permuterm(items: DataFrame, term: str) -> DataFrame:
    """(rotation, key): all rotations of term and END."""
    whole = F.concat(F.col(term), F.lit(END))
    n = F.length(whole)
    turns = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(whole, i), F.substr(whole, F.lit(1), i - 1)))
    return items.select(F.explode(turns).alias("rotation"), "key")


def wildcard(index: DataFrame, pattern: str) -> DataFrame:
    """Keys whose term matches a pattern in which each star stands for any characters.

    The ends of the pattern become a prefix of a rotation, which the index scan is asked for; what
    stands between inner stars is looked for in the rotations found.
    """
    head, *inner, tail = pattern.split("*") if "*" in pattern else (pattern, "")
    if "*" not in pattern:
        return index.where(F.col("rotation") == pattern + END).select("key")
    if not head and not tail:
        # The first inner piece can begin a rotation; others must follow it before the term's end.
        first, *inner = [x for x in inner if x] or [""]
        ahead = index.where(F.col("rotation").startswith(first))
    else:
        first = tail + END + head
        ahead = index.where(F.col("rotation").startswith(first))
    inner = [x for x in inner if x]
    if inner:
        between = "[^" + END + "]*"
        ahead = ahead.where(F.substr("rotation", F.lit(len(first) + 1)).rlike("^" + between + between.join(map(re.escape, inner))))
    return ahead.select("key").distinct()


def out_edges(triples: DataFrame, subject, verb: str) -> DataFrame:
    return triples.where((F.col("s") == F.lit(subject)) & (F.col("v") == verb)).select("o")


def two_hops(triples: DataFrame, first: str, second: str) -> DataFrame:
    a = triples.where(F.col("v") == first).select("s", F.col("o").alias("mid"))
    b = triples.where(F.col("v") == second).select(F.col("s").alias("mid"), "o")
    return a.join(b, "mid").select("s", "mid", "o")


def dequeue(queue: DataFrame, n: int) -> DataFrame:
    """The first n keys of a queue."""
    return queue.orderBy("key").limit(n)


def content_refs(items: DataFrame) -> DataFrame:
    """(sha, refs, first_key): content addresses, how many keys refer to each, and the first of them."""
    return items.groupBy(F.sha2("value", 256).alias("sha")).agg(F.count("*").alias("refs"), F.min("key").alias("first_key"))
