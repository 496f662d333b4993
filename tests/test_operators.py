"""Semantics of the operators on small logs, and against a plain model on random ones."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrand.model import Range, big_endian, check_key, from_big_endian, successor
from keystrand.operators import index, maintain, read, transactions, write
from keystrand.operators.resolve import drop_cleared, newest, overlay, resolve, resolve_many

SCHEMA = "keyspace_id long, key string, seqno long, batch_ord int, kind string, value string"


def log(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(1, k, s, o, kind, v) for k, s, o, kind, v in rows], schema)


def items(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_batch_last_write_wins(spark):
    rows = [("1", 0, 0, "V", "abc"), ("1", 0, 1, "V", "def"), ("1", 0, 2, "V", "ghi")]
    assert items(resolve(log(spark, rows))) == {"1": "ghi"}
    assert items(resolve(log(spark, rows), 0)) == {}


def test_remove_then_insert_in_one_batch(spark):
    assert items(resolve(log(spark, [("a", 3, 0, "T", None), ("a", 3, 1, "V", "x")]))) == {"a": "x"}
    assert items(resolve(log(spark, [("a", 3, 0, "V", "x"), ("a", 3, 1, "W", None)]))) == {}


def test_approximate_length_counts_versions(spark):
    df = log(spark, [("1", 0, 0, "V", "a"), ("1", 1, 0, "T", None)])
    assert read.approximate_length(df).first()[0] == 2
    assert read.length(df).first()[0] == 0
    assert read.is_empty(df).first()[0]


def test_clear_is_seen_by_later_instants_only(spark):
    df = log(spark, [("a", 0, 0, "V", "a"), (None, 1, 0, "C", None), ("b", 2, 0, "V", "b")])
    assert items(resolve(drop_cleared(df, 1), 1)) == {"a": "a"}
    assert items(resolve(drop_cleared(df))) == {"b": "b"}


def test_ranges_and_prefixes(spark):
    df = log(spark, [(k, 0, i, "V", k) for i, k in enumerate(["a", "ab", "abc", "f", "g"])])
    assert set(items(read.prefix(df, "ab"))) == {"ab", "abc"}
    assert set(items(read.prefix(df, ""))) == {"a", "ab", "abc", "f", "g"}
    assert set(items(read.range_(df, Range("a", "f", True, True)))) == {"a", "ab", "abc", "f"}
    assert set(items(read.range_(df, Range("a", "f", False, False)))) == {"ab", "abc"}
    assert [r["key"] for r in read.ordered(read.scan(df), reverse=True).collect()] == ["g", "f", "abc", "ab", "a"]
    assert read.first(read.scan(df)).first()["key"] == "a" and read.last(read.scan(df)).first()["key"] == "g"


def test_binary_prefix(spark):
    keys = [b"\x00\x01", b"a", b"a\xff", b"a\xff\x01", b"b", b"\xff", b"\xff\xff"]
    df = log(spark, [(k, 0, i, "V", "v") for i, k in enumerate(keys)], SCHEMA.replace("key string", "key binary"))
    for p in (b"a", b"a\xff", b"\xff", b"\xff\xff", b""):
        got = {bytes(r["key"]) for r in read.prefix(df, p).collect()}
        assert got == {k for k in keys if k.startswith(p)}


def test_successor():
    assert successor(b"ab") == b"ac" and successor(b"a\xff") == b"b" and successor(b"\xff") is None and successor(b"") is None


def test_big_endian_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 255, 256, 2**40)], "x long").select("x", big_endian(F.col("x")).alias("k"))
    got = df.orderBy("k").select("x", from_big_endian(F.col("k")).alias("y"), F.length("k").alias("n")).collect()
    assert [r["x"] for r in got] == [0, 1, 255, 256, 2**40] and all(r["x"] == r["y"] and r["n"] == 8 for r in got)


def test_keys_are_checked():
    for bad in (b"", b"x" * 65_536):
        with pytest.raises(ValueError):
            check_key(bad)
    check_key(b"x" * 65_535)


def test_update_skips_unchanged_values(spark):
    live = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9)], "key string, value int")
    out = {r["key"]: (r["prev"], r["new"], r["written"]) for r in write.update(live, lambda v: F.when(v < 5, F.greatest(v, F.lit(2)))).collect()}
    assert out == {"a": (1, 2, True), "b": (2, 2, False), "c": (9, None, True)}
    some = write.update_keys(live, spark.createDataFrame([("a",), ("z",)], "key string"), lambda v: F.coalesce(v, F.lit(0)) + 1)
    assert {r["key"]: (r["prev"], r["new"]) for r in some.collect()} == {"a": (1, 2), "z": (None, 1)}
    rows = {r["key"]: r["kind"] for r in write.update_rows(write.update(live, lambda v: F.when(v < 5, v + 1)), 7).collect()}
    assert rows == {"a": "V", "b": "V", "c": "T"}


def test_overlay_reads_own_writes(spark):
    base = log(spark, [("a", 0, 0, "V", "a"), ("b", 9, 0, "V", "late")])
    own = log(spark, [("a", 1 << 62, 0, "T", None), ("c", (1 << 62) + 1, 0, "V", "c")])
    assert items(resolve(overlay(base, own, 5))) == {"c": "c"}
    assert {r["key"]: r["kind"] for r in write.write_set(own).collect()} == {"a": "T", "c": "V"}


def test_conflicts_need_a_read(spark):
    reads = spark.createDataFrame([(2, 1), (7, 1)], "tx long, key long")
    writes = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (6, 1)], "tx long, key long")
    got = {(r["tx"], r["writer"]) for r in transactions.point_conflicts(reads, writes, 2).collect()}
    assert got == {(2, 1), (7, 6)}


def test_fifo_by_size(spark):
    df = spark.createDataFrame([(i, 10 + i % 3) for i in range(1000)], "k long, n long")
    want, total = set(), 0
    for i in range(999, -1, -1):
        total += 10 + i % 3
        if total > 777:
            break
        want.add(i)
    for cells in (1, 7, 4096):
        assert {r["k"] for r in maintain.fifo_by_size(df, "k", "n", 777, cells).collect()} == want


def test_filter_verdicts(spark):
    df = spark.createDataFrame([("a", "1"), ("abc", "2"), ("b", "3"), ("z", None)], "key string, value string")
    verdict = F.when(F.col("key") == "b", maintain.REMOVE).when(F.col("value") == "2", maintain.REPLACE)
    assert items(maintain.apply_filter(df, verdict, F.lit("new"))) == {"a": "1", "abc": "new", "z": None}


def test_ttl_keeps_what_it_cannot_decode(spark):
    df = spark.createDataFrame([("a", '{"ttl": 0}'), ("b", '{"ttl": 10}'), ("c", "junk")], "key string, value string")
    ttl = F.from_json("value", "ttl bigint")["ttl"]
    assert {k: set(items(maintain.expire(df, ttl, k))) for k in (0, 9, 10)} == {0: {"b", "c"}, 9: {"b", "c"}, 10: {"c"}}


def test_wildcards(spark):
    words = ["water", "waterfall", "daughter", "wonder", "er"]
    idx = index.permuterm(spark.createDataFrame([(w, w) for w in words], "key string, term string"), "term")
    for pattern, like in (("water", "water"), ("wa*", "wa%"), ("*er", "%er"), ("*a*", "%a%"), ("w*r", "w%r")):
        want = {w for w in words if re.fullmatch(like.replace("%", ".*"), w)}
        assert {r["key"] for r in index.wildcard(idx, pattern).collect()} == want, pattern


OPS = st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("VVVTW"), st.integers(0, 9)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(ops=OPS, data=st.data())
def test_against_a_dictionary(spark, ops, data):
    instants = sorted(data.draw(st.sets(st.integers(0, len(ops)), min_size=2, max_size=4)))
    model, at = {}, {0: {}}
    for s, (k, kind, v) in enumerate(ops):
        model = dict(model)
        model.pop(k, None)
        if kind == "V":
            model[k] = str(v)
        at[s + 1] = model
    df = log(spark, [(k, s, 0, kind, str(v) if kind == "V" else None) for s, (k, kind, v) in enumerate(ops)])
    many = resolve_many(df, instants).collect()
    for i in instants:
        assert {r["key"]: r["value"] for r in many if r["instant"] == i} == at[i]
    mark = instants[0]
    packed = maintain.compact(df, mark)
    for i in instants[:1] + instants[-1:]:
        assert items(resolve(packed, i)) == at[i]


def test_compaction_keeps_nothing_else(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), s, 0, rng.choice("VVT"), "x") for s in range(60)]
    kept = {(r["key"], r["seqno"]) for r in maintain.compact(log(spark, rows), 30).collect()}
    below = {k: max(s for kk, s, *_ in rows if kk == k and s < 30) for k in "abc"}
    want = {(k, s) for k, s, *_ in rows if s >= 30} | {(k, s) for k, s, _, kind, _ in rows if s < 30 and below[k] == s and kind == "V"}
    assert kept == want


def test_newest_keeps_tombstones(spark):
    assert {r["key"]: r["kind"] for r in newest(log(spark, [("a", 0, 0, "V", "x"), ("a", 1, 0, "T", None)])).collect()} == {"a": "T"}


def test_outcomes_in_commit_order(spark):
    """A transaction that failed is no writer for those after it."""
    from keystrand.operators import transactions

    rng = random.Random(6)
    for window, chunk in ((3, 4), (5, 16), (1, 1024)):
        txs = sorted(rng.sample(range(60), 45))
        pairs = [(t, w) for t in txs for w in txs if 0 < t - w <= window and rng.random() < 0.5]
        ok: dict[int, bool] = {}
        for t in txs:
            ok[t] = not any(a == t and ok[w] for a, w in pairs)
        got = transactions.outcomes(spark.createDataFrame([(t,) for t in txs], "tx long"), spark.createDataFrame(pairs, "tx long, writer long"), window, chunk)
        assert {r["tx"]: r["outcome"] == "ok" for r in got.collect()} == ok


def test_weak_deletes_follow_the_order(spark):
    rows = [("a", 0, 0, "V", "1"), ("a", 1, 0, "W", None), ("a", 2, 0, "V", "2"), ("b", 0, 0, "V", "1"), ("b", 1, 0, "W", None), ("c", 0, 0, "V", "1")]
    assert {r["key"]: r["value"] for r in maintain.annihilate_weak(log(spark, rows)).collect()} == {"a": "2", "c": "1"}


def test_wildcards_against_patterns(spark):
    import re

    from keystrand.operators import index

    rng = random.Random(11)
    terms = sorted({"".join(rng.choice("ab.") for _ in range(rng.randrange(1, 8))) for _ in range(60)})
    entries = index.permuterm(spark.createDataFrame([(t, t) for t in terms], "key string, term string"), "term").cache()
    for pattern in ("ab", "a*", "*b", "a*b", "*a*", "*", "**", "a*.*b", "*a*b*", "*ab*a*", "a*b*a*b", ".*a", "*.*.*"):
        wanted = re.compile(".*".join(map(re.escape, pattern.split("*"))))
        assert sorted(r["key"] for r in index.wildcard(entries, pattern).collect()) == [t for t in terms if wanted.fullmatch(t)], pattern
