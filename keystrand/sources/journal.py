"""Binary journals: framed batches, read in parallel by file, torn tails discarded.

A batch is a start record (number of records, sequence number), its records
(items or clears of keyspaces) and an end record with the XXH3 hash of the
records' bytes and a trailer.  A batch without a proper end, or one that runs
into the next start, is the torn tail of a broken-off write and is left out
with all that follows; a complete batch with a wrong hash is an error.

A writer keeps one journal open and starts the next when it has grown; journals
whose batches have all reached a database can be evicted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keystrand.model import CLEAR, TOMBSTONE, VALUE, WEAK

# Fixed values of the format: record tags, kinds, compressions. All numbers are little-endian.
START, ITEM, END, CLEARED = 1, 2, 3, 4
KINDS = {0: VALUE, 1: TOMBSTONE, 2: WEAK}
PLAIN, LZ4 = 0, 1
TRAILER = b"KST\1"
_START, _ITEM, _SIZES, _END, _CLEAR = struct.Struct("<BIQ"), struct.Struct("<BBB"), struct.Struct("<QHII"), struct.Struct("<BQ"), struct.Struct("<BQ")

SCHEMA = "keyspace_id long, key binary, seqno long, batch_ord int, kind string, value binary, file string"


def encode_batch(seqno: int, rows: list[tuple], compress_from: int = 4096, trailer: bytes = TRAILER) -> bytes:
    """One framed batch of rows (keyspace_id, kind, key, value)."""
    import xxhash

    codes = {k: c for c, k in KINDS.items()}
    body = bytearray()
    for keyspace, kind, key, value in rows:
        if kind == CLEAR:
            body += _CLEAR.pack(CLEARED, keyspace)
            continue
        value = value or b""
        stored, how = value, PLAIN
        if len(value) >= compress_from:
            stored, how = pa.Codec("lz4_raw").compress(value, asbytes=True), LZ4
        body += _ITEM.pack(ITEM, codes[kind], how) + _SIZES.pack(keyspace, len(key), len(value), len(stored)) + key + stored
    return _START.pack(START, len(rows), seqno) + bytes(body) + _END.pack(END, xxhash.xxh3_64_intdigest(bytes(body))) + trailer


def decode(data: bytes, trailer: bytes = TRAILER) -> Iterator[tuple]:
    """Rows (keyspace_id, key, seqno, batch_ord, kind, value) of all whole batches."""
    import xxhash

    at = 0
    while at < len(data):
        if data[at] != START or at + _START.size > len(data):
            return
        _, count, seqno = _START.unpack_from(data, at)
        at += _START.size
        first, rows = at, []
        try:
            while len(rows) < count:
                tag = data[at]
                if tag == CLEARED:
                    rows.append((_CLEAR.unpack_from(data, at)[1], None, seqno, len(rows), CLEAR, None))
                    at += _CLEAR.size
                elif tag == ITEM:
                    _, kind, how = _ITEM.unpack_from(data, at)
                    keyspace, n_key, n_value, n_stored = _SIZES.unpack_from(data, at + _ITEM.size)
                    start = at + _ITEM.size + _SIZES.size
                    at = start + n_key + n_stored
                    if at > len(data):
                        return
                    key, stored = data[start : start + n_key], data[start + n_key : at]
                    value = pa.Codec("lz4_raw").decompress(stored, n_value, asbytes=True) if how == LZ4 else stored
                    rows.append((keyspace, key, seqno, len(rows), KINDS[kind], value if KINDS[kind] == VALUE else None))
                else:
                    return
            tag, expected = _END.unpack_from(data, at)
            if tag != END or data[at + _END.size : at + _END.size + len(trailer)] != trailer:
                return
        except (IndexError, struct.error, KeyError):
            return
        if xxhash.xxh3_64_intdigest(data[first:at]) != expected:
            raise ValueError(f"the batch at byte {first - _START.size} does not have the hash it says")
        yield from rows
        at += _END.size + len(trailer)


def read_journals(spark: SparkSession, path: str, trailer: bytes = TRAILER) -> DataFrame:
    """Log rows of journal files under path; each file is decoded where it is read."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(*r, name) for r in decode(data, trailer)]
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


class JournalWriter:
    """Journals in a folder of `files` (a store.Files), each named for the sequence number of its first batch.

    What was written is safe once persist() (or close) has returned: the open journal is then written
    under its name as a whole, as not every file system can append.
    """

    def __init__(self, files, folder: str, rotate_at: int = 64 << 20, trailer: bytes = TRAILER):
        self.files, self.folder, self.rotate_at, self.trailer = files, folder, rotate_at, trailer
        self.first, self.open, self.dirty = None, bytearray(), False

    def write(self, seqno: int, rows: list[tuple]) -> None:
        """Adds a batch of rows (keyspace_id, kind, key, value); a batch is never in two journals."""
        if self.first is None:
            self.first = seqno
        self.open += encode_batch(seqno, rows, trailer=self.trailer)
        self.dirty = True
        if len(self.open) >= self.rotate_at:
            self.rotate()

    def persist(self) -> None:
        if self.dirty:
            self.files.put(f"{self.folder}/{self.first:020d}", bytes(self.open))
            self.dirty = False

    def rotate(self) -> None:
        """Seals the open journal; the next batch begins another."""
        self.persist()
        self.first, self.open = None, bytearray()

    def evict(self, below: int) -> list[str]:
        """Deletes sealed journals all of whose batches have sequence numbers under `below`; their names."""
        names = self.files.list(self.folder)
        gone = [name for name, after in zip(names, [*names[1:], None], strict=True) if int(name) != self.first and after is not None and int(after) <= below]
        for name in gone:
            self.files.delete(f"{self.folder}/{name}")
        return gone

    def __enter__(self) -> JournalWriter:
        return self

    def __exit__(self, *_) -> None:
        self.persist()


def replay(db, path: str, keyspaces: dict[int, str], trailer: bytes = TRAILER) -> int | None:
    """Brings the state after all whole batches of the journals under path into a database, in one commit.

    keyspaces: names by the journals' keyspace ids; those not named are left out.  Keys and values are bytes.
    """
    from keystrand.operators.maintain import latest

    log, batch = read_journals(db.spark, path, trailer), db.batch()
    for id_, name in keyspaces.items():
        ks = db.keyspace(name)
        rows = latest(log.where(log["keyspace_id"] == id_).drop("file"))
        batch.remove_all(ks, rows.where(rows["kind"].isin(TOMBSTONE, WEAK)).select("key"))
        batch.insert_all(ks, rows.where(rows["kind"] == VALUE).select("key", "value"))
        if not rows.where(rows["kind"] == CLEAR).isEmpty():
            batch.clear(ks)
    return batch.commit()
