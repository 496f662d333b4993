"""The database on Parquet: commits, snapshots, recovery, transactions, journals, feeds."""

import os

import pytest
from pyspark.sql import functions as F

from keystrand import errors
from keystrand.model import Range
from keystrand.operators import read
from keystrand.operators.tx import Optimistic, SingleWriter
from keystrand.sources.journal import decode, encode_batch, read_journals
from keystrand.sources.store import Database, rows_of


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def text(db, name="t"):
    return db.keyspace(name, key="string", value="string")


def test_snapshot_batch_and_recovery(db, spark):
    a, b = text(db, "a"), text(db, "b")
    before = db.seqno
    batch = db.batch().insert(a, "1", "abc").insert(a, "1", "ghi").insert(b, "x", "y")
    assert a.is_empty() and len(batch) == 3
    batch.commit()
    assert db.seqno == before + 1
    with db.snapshot() as s:
        a.insert("2", "new")
        a.remove("1")
        assert dict(rows_of(a.iter(s))) == {"1": "ghi"} and dict(rows_of(a.iter())) == {"2": "new"}
        assert b.get("x", s) == "y"
    again = Database(spark, db.root)
    assert again.seqno == db.seqno and again.list_keyspace_names() == ["a", "b"]
    c = again.keyspace("a", key="binary")  # options of an existing keyspace are ignored
    assert c.get("2") == "new" and not c.contains_key("1") and c.size_of("2") == 3 and c.approximate_len() == 4 and c.len() == 1


def test_clear_and_ranges(db):
    t = text(db)
    batch = db.batch()
    for k in ("1", "3", "5"):
        batch.insert(t, k, k * 2)
    batch.commit()
    assert t.first_key_value() == ("1", "11") and t.last_key_value() == ("5", "55")
    assert [k for k, _ in rows_of(t.range(Range("1", "5"), reverse=True))] == ["3", "1"]
    s = db.snapshot()
    t.clear()
    t.insert("7", "x")
    assert dict(rows_of(t.iter())) == {"7": "x"} and t.len(s) == 3
    s.close()


def test_dropped_keyspaces_do_not_come_back(db):
    t = text(db)
    t.insert("a", "a")
    db.delete_keyspace(t)
    assert not db.keyspace_exists("t")
    with pytest.raises(errors.KeyspaceDeleted):
        t.insert("b", "b")
    new = text(db)
    assert new.id > t.id and new.is_empty()
    assert db.vacuum() and db.vacuum() == []


def test_ingestion_overlays_older_rows(db, spark):
    t = text(db)
    t.insert("b", "old")
    t.ingest(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    assert dict(rows_of(t.iter())) == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        t.ingest(spark.createDataFrame([("a", "1"), ("a", "2")], "key string, value string"))
    assert t.len() == 2


def test_compaction_changes_no_read(db):
    t = text(db)
    for n in range(4):
        t.insert("k", str(n))
    t.remove("gone")
    with db.snapshot() as s:
        t.insert("k", "late")
        t.insert("b", "b")
        before = dict(rows_of(t.iter(s))), dict(rows_of(t.iter()))
        t.major_compact()
        assert (dict(rows_of(t.iter(s))), dict(rows_of(t.iter()))) == before
    assert t.approximate_len() == 3
    db.vacuum()
    assert dict(rows_of(t.iter())) == {"k": "late", "b": "b"}
    t.major_compact(lambda k, v: F.when(k == "b", "remove").when(v == "late", "replace"), lambda k, v: F.upper(v))
    assert dict(rows_of(t.iter())) == {"k": "LATE"}


def test_compaction_keeps_places_in_a_batch(db):
    """Rows of one batch share a seqno; compaction must not lose which came last."""
    t = text(db)
    with db.snapshot():
        db.batch().insert(t, "x", "1").remove(t, "x").insert(t, "y", "9").insert(t, "y", "1").commit()
        before = dict(rows_of(t.iter()))
        t.major_compact()
        assert dict(rows_of(t.iter())) == before == {"y": "1"}
    t.major_compact()
    assert dict(rows_of(t.iter())) == before and t.approximate_len() == 1


def test_compaction_keeps_what_a_lease_sees_beyond_a_clear(db):
    t = text(db)
    t.insert("x", "1")
    with db.snapshot() as s:
        t.clear()
        t.insert("y", "2")
        t.major_compact()
        assert t.get("x", s) == "1" and dict(rows_of(t.iter())) == {"y": "2"}
    t.major_compact()
    assert dict(rows_of(t.iter())) == {"y": "2"} and t.approximate_len() == 1


def test_random_histories_under_leases_and_compaction(db):
    """Every open snapshot, and the present, read what a dictionary holds, whatever is compacted."""
    import random

    rng, t, now, leases = random.Random(8), text(db), {}, []
    for _ in range(14):
        what = rng.choice(["batch", "batch", "batch", "clear", "lease", "compact", "drop"])
        if what == "batch":
            batch, now = db.batch(), dict(now)
            for _ in range(rng.randrange(1, 5)):
                k = rng.choice("abc")
                if rng.random() < 0.3:
                    (batch.remove if rng.random() < 0.5 else batch.remove_weak)(t, k)
                    now.pop(k, None)
                else:
                    now[k] = str(rng.random())
                    batch.insert(t, k, now[k])
            batch.commit()
        elif what == "clear":
            t.clear()
            now = {}
        elif what == "lease":
            leases.append((db.snapshot(), now))
        elif what == "compact":
            t.major_compact()
        elif leases:
            leases.pop(rng.randrange(len(leases)))[0].close()
    t.major_compact()
    db.vacuum()
    assert dict(rows_of(t.iter())) == now
    for s, then in leases:
        assert dict(rows_of(t.iter(s))) == then
        s.close()


def test_writers_wait_for_the_lock(db, spark):
    import threading
    import time

    t, sw = text(db), SingleWriter(db)
    tx = sw.write_tx()
    tx.insert(t, "a", "1")
    began = time.time()
    threading.Timer(0.6, tx.commit).start()
    with SingleWriter(Database(spark, db.root)).write_tx(wait=30) as later:
        assert time.time() - began > 0.5 and later.get(t, "a") == "1"
        with pytest.raises(errors.Locked):
            sw.write_tx(wait=0.1)
    # The lock of a holder that broke off lapses, and its late release does not take another's lock away.
    lost = SingleWriter(db, seconds=0.1).write_tx()
    time.sleep(0.2)
    new = sw.write_tx()
    lost.rollback()
    with pytest.raises(errors.Locked):
        sw.write_tx()
    new.rollback()
    assert not db.files.exists("lock")


def test_key_bounds_reach_the_files(db, spark):
    t = text(db)
    t.ingest(spark.range(1000).selectExpr("lpad(id, 4, '0') as key", "'x' as value"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = t.range(Range("0100", "0200"))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,0100)" in plan and "LessThan(key,0200)" in plan
    assert "EqualTo(key,0500)" in read.get(t.log(), "0500")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_content_store(db, spark):
    from keystrand.operators.cas import ContentStore

    cas, df = ContentStore(db, "c"), lambda *x: spark.createDataFrame(list(x), "key string, value string")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    cas.put(df(("a", "x"), ("b", "x"), ("c", "y")))
    cas.put(df(("a", "x"), ("c", "z")))  # one stays, one changes
    cas.remove(keys("b", "nothing"))
    assert sorted(v for _, v in rows_of(cas.counts.iter())) == [1, 1]
    assert dict(rows_of(cas.get(keys("a", "b", "c")))) == {"a": "x", "c": "z"} and cas.blobs.len() == 2
    cas.remove(keys("a", "c"))
    assert cas.blobs.is_empty() and cas.counts.is_empty() and cas.links.is_empty()


def test_a_writer_that_breaks_off_blocks_nobody(db, spark, monkeypatch):
    """A draft without its name, and one that raises while it gets it, leave the commit number free."""
    from keystrand.sources.store import Files

    t = text(db)
    publish, n = Files._publish, len(db._commits)

    def broken(*_):
        raise RuntimeError("power cut")

    monkeypatch.setattr(Files, "_publish", broken)
    with pytest.raises(RuntimeError):
        t.insert("a", "lost")
    with pytest.raises(errors.Poisoned):
        t.insert("a", "lost")
    monkeypatch.setattr(Files, "_publish", publish)
    again = Database(spark, db.root)
    text(again).insert("a", "kept")
    assert len(again._commits) == n + 1 and dict(rows_of(text(again).iter())) == {"a": "kept"}
    assert again.vacuum() != [] and again.vacuum() == [] and again.files.list("drafts") == []


def test_lost_races_end(db, spark, monkeypatch):
    """A transaction that always comes second gives up, and leaves no files behind."""
    t = text(db)
    t.insert("a", "1")
    folders = len(db.files.list(f"data/{t.id}"))
    monkeypatch.setattr(type(db.files), "_publish", lambda self, draft, target: self.fs.mkdirs(target) and _taken())
    tx = Optimistic(db).write_tx()
    tx.insert(t, "b", "2")
    monkeypatch.setattr(type(db), "refresh", lambda self: None)
    with pytest.raises(errors.Conflict):
        tx.commit(tries=3)
    assert len(db.files.list(f"data/{t.id}")) == folders


def _taken():
    from py4j.protocol import Py4JJavaError

    class Taken(Py4JJavaError):
        def __init__(self):
            self.java_exception = "FileAlreadyExistsException"

        def __str__(self):
            return "taken"

    raise Taken


def test_keys_of_a_bulk_load_are_checked(db, spark):
    t = text(db)
    for bad in ("", "x" * 70_000):
        with pytest.raises(Exception, match="1 to 65535 bytes"):
            t.ingest(spark.createDataFrame([("a", "1"), (bad, "2")], "key string, value string"))
        with pytest.raises(Exception, match="1 to 65535 bytes"):
            db.batch().insert_all(t, spark.createDataFrame([(bad, "2")], "key string, value string")).commit()
    assert t.is_empty()


def test_files_without_a_commit_are_ignored(db, spark):
    t = text(db)
    t.insert("a", "a")
    spark.createDataFrame([("z", 99, 0, "V", "z")], t.schema).write.parquet(f"{t.path}/orphan")
    assert Database(spark, db.root).keyspace("t").len() == 1
    assert any("orphan" in x for x in db.vacuum())


def test_two_writers_of_one_commit(db, spark):
    other = Database(spark, db.root)
    text(db).insert("a", "a")
    with pytest.raises(errors.Conflict):
        other._commit(5)
    assert not other.poisoned


def test_single_writer(db):
    t, sw = text(db), SingleWriter(db)
    t.insert("a", "a")
    with sw.write_tx() as tx:
        with pytest.raises(errors.Locked):
            sw.write_tx()
        assert tx.fetch_update(t, "a", lambda v: v + "!") == "a" and tx.get(t, "a") == "a!"
        tx.remove(t, "a")
        tx.insert(t, "b", "b")
        assert not tx.contains_key(t, "a") and [r["key"] for r in tx.iter(t).collect()] == ["b"]
        assert t.contains_key("a")
    assert dict(rows_of(t.iter())) == {"b": "b"}
    tx = sw.write_tx()
    tx.insert(t, "c", "c")
    tx.rollback()
    assert t.len() == 1


def setup_pair(db):
    t = text(db)
    db.batch().insert(t, "1", "10").insert(t, "2", "20").commit()
    return t, Optimistic(db)


def test_write_skew_is_refused(db):
    t, o = setup_pair(db)
    a, b = o.write_tx(), o.write_tx()
    for tx in (a, b):
        assert tx.get(t, "1") == "10" and tx.get(t, "2") == "20"
    a.insert(t, "1", "11")
    b.insert(t, "2", "21")
    a.commit()
    with pytest.raises(errors.Conflict):
        b.commit()


def test_blind_writes_do_not_conflict(db):
    t, o = setup_pair(db)
    a, b = o.write_tx(), o.write_tx()
    a.insert(t, "1", "11")
    b.insert(t, "1", "12")
    a.commit()
    b.commit()
    assert t.get("1") == "12"


def test_phantoms_and_sizes(db):
    t, o = setup_pair(db)
    a = o.write_tx()
    a.range(t, Range("1", "9")).count()
    a.insert(t, "0", "x")
    b = o.write_tx()
    assert b.size_of(t, "3") is None  # asking for a size reads nothing
    b.insert(t, "5", "y")
    t.insert("3", "z")
    b.commit()
    with pytest.raises(errors.Conflict):
        a.commit()
    reader = o.write_tx()
    reader.len(t)
    t.insert("4", "q")
    assert reader.commit() is None  # read-only transactions never conflict


def test_retries(db):
    t, o = setup_pair(db)
    seen = []

    def work(tx):
        seen.append(tx.get(t, "1"))
        if len(seen) == 1:
            t.insert("1", "15")
        tx.insert(t, "1", str(int(tx.get(t, "1")) + 1))

    o.run(work)
    assert t.get("1") == "16" and seen == ["10", "15"]


def test_journal_frames(spark, tmp_path):
    pytest.importorskip("xxhash")
    good = encode_batch(1, [(1, "V", b"abc", b"def"), (1, "V", b"yxc", b"g" * 5000), (2, "T", b"k", None), (2, "C", None, None)])
    rows = list(decode(good))
    assert [r[4] for r in rows] == ["V", "V", "T", "C"] and rows[1][5] == b"g" * 5000
    more = encode_batch(2, [(1, "V", b"n", b"")])
    for torn in (more[:-1], more[:20], b"\2", b"\3" * 40, b"\1\1", more[:13] + more):
        assert list(decode(good + torn)) == rows
    with pytest.raises(ValueError):
        bad = bytearray(good)
        bad[45] ^= 1
        list(decode(bytes(bad)))
    os.makedirs(tmp_path / "j")
    (tmp_path / "j" / "0.log").write_bytes(good + more[:-3])
    (tmp_path / "j" / "1.log").write_bytes(more)
    assert read_journals(spark, f"file://{tmp_path}/j").count() == 5


def test_feed_state_equals_batch(db, spark, tmp_path):
    from keystrand.streaming import feed

    t, other = text(db), text(db, "other")
    for k, v in (("a", "1"), ("b", "2"), ("a", "3")):
        t.insert(k, v)
    t.remove("b")
    other.insert("z", "z")
    # A file that no commit names, and one that only compaction made, are no changes.
    spark.createDataFrame([("orphan", 99, 0, "V", "x")], t.schema).write.parquet(f"{t.path}/orphan")
    other.major_compact()
    cp = f"file://{tmp_path}/cp"
    assert {r["key"]: r["value"] for r in feed.maintain_state(t, cp, 2).collect()} == {"a": "3"}
    t.insert("c", "4")
    t.clear()
    db.batch().insert(t, "d", "5").insert(t, "d", "6").commit()
    for _ in range(2):
        assert {r["key"]: r["value"] for r in feed.maintain_state(t, cp, 2).collect()} == dict(rows_of(t.iter())) == {"d": "6"}
    assert feed.maintain_state(text(db, "new"), f"file://{tmp_path}/cp2").isEmpty()


def test_filters_by_keyspace_stats_and_temporary(spark, tmp_path):
    from keystrand.sources.store import Filter

    keep_a = Filter(lambda k, v: F.when(~k.startswith("a"), "remove"))
    with Database(spark, f"file://{tmp_path}/tmp", temporary=True, filters=lambda name: keep_a if name == "my_items" else None) as db:
        mine, other = text(db, "my_items"), db.keyspace("my_items_imposter", key="string", value="string", kv_separation=True)
        assert other.is_kv_separated() and other.options() == {"kv_separation": True} and not mine.is_kv_separated()
        for t in (mine, other):
            db.batch().insert(t, "a", "1").insert(t, "abc", "2").insert(t, "b", "3").commit()
            t.major_compact()
        assert set(dict(rows_of(mine.iter()))) == {"a", "abc"} and set(dict(rows_of(other.iter()))) == {"a", "abc", "b"}
        mine.move_to(other, ["abc", "zzz"])
        assert dict(rows_of(mine.iter())) == {"a": "1"} and other.get("abc") == "2"
        stats = {r["keyspace"]: r for r in db.stats().collect()}
        assert stats["my_items"]["compactions"] == 1 and stats["my_items"]["bytes"] > 0 and stats["my_items"]["commits"] == 2
        with db.snapshot() as s, s.clone() as c:
            assert c.instant == s.instant and len(db.files.list("leases")) == 2
        assert db.files.list("leases") == []
    assert not os.path.exists(tmp_path / "tmp" / "manifest")


def test_checkpoints_of_the_manifest(db, spark, monkeypatch):
    from keystrand.sources import store

    monkeypatch.setattr(store, "CHECKPOINT", 3)
    t = text(db)
    for n in range(6):
        t.insert("k", str(n))
    assert len(db.files.list("checkpoints")) == 2
    again = Database(spark, db.root)
    assert again._commits == db._commits and again.seqno == db.seqno and text(again).get("k") == "5"


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from keystrand.streaming import feed

    rows = spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-01-01 00:00:50",), ("2024-01-01 00:01:10",)], "s string").select(F.to_timestamp("s").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/in")
    out = feed.late_counts(stream, "ts", "1 minute", "10 seconds").writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


def test_codecs(spark):
    from keystrand.functions import codecs

    df = spark.createDataFrame([(1994, "id-1", '{"ttl": 5}', "s\0v\0o"), (300, "b", "junk", "x")], "year long, id string, j string, k string")
    got = df.select(codecs.year_index_key(F.col("year"), F.col("id")).alias("i"), codecs.try_json(F.col("j"), "ttl int")["ttl"].alias("t"), codecs.split_compound(F.col("k"), 1).alias("v"), codecs.encode_json(F.col("id")).alias("e"), codecs.compound(F.col("id"), F.col("k")).alias("c")).collect()
    assert [bytes(r["i"]) for r in got] == [(1994).to_bytes(8, "big") + b"\0id-1", (300).to_bytes(8, "big") + b"\0b"]
    assert [r["t"] for r in got] == [5, None] and [r["v"] for r in got] == ["v", None] and got[1]["e"] == '{"id":"b"}' and got[1]["c"] == "b\0x"


def test_journal_writer_rotation_eviction_and_replay(db, spark):
    from keystrand.sources.journal import JournalWriter, replay

    with JournalWriter(db.files, "journal", rotate_at=200) as w:
        for n in range(10):
            w.write(n, [(1, "V", f"k{n % 4}".encode(), f"v{n}".encode()), (2, "V", b"x", b"y")])
        w.write(10, [(1, "T", b"k0", None), (2, "C", None, None), (2, "V", b"z", b"1")])
    names = db.files.list("journal")
    assert len(names) > 2 and names[0] == f"{0:020d}"
    old = db.keyspace("two")
    old.insert(b"before", b"gone")
    replay(db, f"{db.root}/journal", {1: "one", 2: "two"})
    assert dict(rows_of(db.keyspace("one").iter())) == {b"k1": b"v9", b"k2": b"v6", b"k3": b"v7"}
    assert dict(rows_of(old.iter())) == {b"z": b"1"}
    assert w.evict(int(names[2])) == names[:2] and db.files.list("journal") == names[2:]
    assert w.evict(100) == names[2:-1]  # the open one stays
    torn = JournalWriter(db.files, "torn")
    torn.write(0, [(1, "V", b"a", b"1")])
    torn.write(1, [(1, "V", b"b", b"2")])
    db.files.put("torn/0", bytes(torn.open[:-3]))
    replay(db, f"{db.root}/torn", {1: "three"})
    assert dict(rows_of(db.keyspace("three").iter())) == {b"a": b"1"}
