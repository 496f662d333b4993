"""Isolation anomalies, each with two or three overlapping optimistic transactions on keys 1 -> 10, 2 -> 20."""

import pytest

from keystrand import errors
from keystrand.model import Range
from keystrand.operators.tx import Optimistic
from keystrand.sources.store import Database, rows_of


@pytest.fixture
def pair(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    t = db.keyspace("t", key="string", value="string")
    db.batch().insert(t, "1", "10").insert(t, "2", "20").commit()
    return t, Optimistic(db)


def refused(tx):
    with pytest.raises(errors.Conflict):
        tx.commit()


def test_write_cycles_serialise(pair):
    """G0: blind writes of both transactions never mix."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    for tx, v in ((a, "1"), (b, "2")):
        tx.insert(t, "1", "1" + v)
        tx.insert(t, "2", "2" + v)
    a.commit()
    b.commit()
    assert dict(rows_of(t.iter())) == {"1": "12", "2": "22"}


def test_aborted_reads(pair):
    """G1a: what is rolled back is never seen."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    a.insert(t, "1", "101")
    assert b.get(t, "1") == "10"
    a.rollback()
    assert b.get(t, "1") == "10"
    assert b.commit() is None


def test_intermediate_reads(pair):
    """G1b: only a transaction's last write is seen, and only after its commit."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    a.insert(t, "1", "101")
    assert b.get(t, "1") == "10"
    a.insert(t, "1", "11")
    a.commit()
    assert b.get(t, "1") == "10" and t.get("1") == "11"


def test_circular_information_flow(pair):
    """G1c: each reads what the other writes; one is refused."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    a.insert(t, "1", "11")
    b.insert(t, "2", "22")
    assert a.get(t, "2") == "20" and b.get(t, "1") == "10"
    a.commit()
    refused(b)


def test_lost_update(pair):
    """P4: both read and write the same key; the second is refused."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    for tx in (a, b):
        tx.fetch_update(t, "1", lambda v: str(int(v) + 1))
    a.commit()
    refused(b)
    assert t.get("1") == "11"


def test_read_skew(pair):
    """G-single: a snapshot never shows half of a commit; a writer that read the old half is refused."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    assert a.get(t, "1") == "10"
    b.insert(t, "1", "12")
    b.insert(t, "2", "18")
    b.commit()
    assert a.get(t, "2") == "20"
    a.insert(t, "3", "x")
    refused(a)


def test_swap(pair):
    """Both exchange the two values by reading all of them."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    for tx in (a, b):
        rows = {r["key"]: r["value"] for r in tx.iter(t).collect()}
        tx.insert(t, "1", rows["2"])
        tx.insert(t, "2", rows["1"])
    a.commit()
    refused(b)
    assert dict(rows_of(t.iter())) == {"1": "20", "2": "10"}


def test_anti_dependency_by_predicate(pair):
    """G2: each adds a row that the other's range read would have found."""
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    for tx, k in ((a, "3"), (b, "4")):
        assert tx.range(t, Range("3", "9")).isEmpty()
        tx.insert(t, k, "30")
    a.commit()
    refused(b)


def test_prefix_phantoms(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    t, o = db.keyspace("b"), Optimistic(db)
    a, b, c = o.write_tx(), o.write_tx(), o.write_tx()
    assert a.prefix(t, b"ab").isEmpty()
    a.insert(t, b"x", b"1")
    b.insert(t, b"abc", b"2")
    c.prefix(t, b"b").count()
    c.insert(t, b"y", b"3")
    b.commit()
    refused(a)
    c.commit()
    assert set(dict(rows_of(t.iter()))) == {b"abc", b"y"}


def test_crossing_range_sums(spark, tmp_path):
    """Each sums one range and writes the sum into the other's."""
    db = Database(spark, f"file://{tmp_path}/db")
    t = db.keyspace("t", key="string", value="long")
    db.batch().insert(t, "a1", 10).insert(t, "b1", 100).insert(t, "b2", 200).commit()
    o = Optimistic(db)
    a, b = o.write_tx(), o.write_tx()
    total = lambda tx, lo, hi: sum(r["value"] for r in tx.range(t, Range(lo, hi)).collect())
    a.insert(t, "a2", total(a, "b", "c"))
    b.insert(t, "b3", total(b, "a", "b"))
    a.commit()
    refused(b)
    assert sum(v for k, v in rows_of(t.range(Range("a", "b")))) == 310


def test_taking_marks_both_ways(pair):
    t, o = pair
    a, b = o.write_tx(), o.write_tx()
    assert a.take(t, "1") == "10" and b.update_fetch(t, "1", lambda v: v) == "10"
    b.insert(t, "9", "z")
    a.commit()
    refused(b)
    assert not t.contains_key("1") and not t.contains_key("9")
