"""A database on plain Parquet: data files, a commit manifest, a catalogue, leases.

Layout under the root, on any file system that Spark reaches:

  format.json                     format version
  manifest/00000000000000000042   one file for each commit, created once and never changed
  checkpoints/                    all commits up to a number in one file
  data/<keyspace id>/<commit>/    Parquet files of a commit, sorted by key
  leases/<name>                   instants that open snapshots hold
  lock                            held by a single writer

Executors write data files first; creating the manifest file is what makes a
commit visible, to all its keyspaces at once.  Files that no manifest names are
ignored by readers and deleted by vacuum().  A manifest file appears by one atomic
step that fails if the name is taken (a hard link on a local disk, a rename that does
not overwrite elsewhere), so of two writers of one commit number the loser sees
Conflict, and a writer that breaks off before that step leaves nothing that blocks
others.  The file system must have such a rename; plain object stores do not.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand import errors
from keystrand.model import CLEAR, MAX_KEY, TOMBSTONE, VALUE, WEAK, Range, check_key, check_name
from keystrand.operators import maintain, read
from keystrand.operators.resolve import drop_cleared

FORMAT = 1
CHECKPOINT = 50
#: Row groups are skipped by the keys' order and, for point reads, by bloom filters.
WRITE = {"compression": "zstd", "parquet.bloom.filter.enabled#key": "true"}


@dataclass(frozen=True)
class Filter:
    """A compaction filter: verdict(key, value) is keep, remove or replace; replacement(key, value) the new value."""

    verdict: Callable[[Column, Column], Column]
    replacement: Callable[[Column, Column], Column] | None = None


class Files:
    """The few file operations that commits need, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> bool:
        """Makes a file appear with all its contents, or returns False if it exists."""
        target, draft = self._path(name), self._path(f"drafts/{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(target.getParent())
        try:
            self._publish(draft, target)
        except Py4JJavaError as e:
            if not self.fs.exists(target):
                raise
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self.fs.delete(draft, False)
        return True

    def _publish(self, draft, target) -> None:
        """Gives the draft its name, or raises if the name is taken."""
        if self.fs.getScheme() == "file":
            path = self.jvm.java.nio.file.Paths
            none = self._gateway.new_array(self.jvm.java.lang.String, 0)
            self.jvm.java.nio.file.Files.createLink(path.get(target.toUri().getPath(), none), path.get(draft.toUri().getPath(), none))
            return
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kinds, 1)
        how[0] = kinds.NONE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(draft, target, how)

    def put(self, name: str, data: bytes) -> None:
        """Writes a file of bytes."""
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(data))
        out.close()

    def read(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def list(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self._path(name)))

    def size(self, name: str) -> int:
        return int(self.fs.getContentSummary(self._path(name)).getLength()) if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Database:
    """A handle to a database; opening one that exists recovers its state from the manifest."""

    def __init__(self, spark: SparkSession, root: str, temporary: bool = False, filters: Callable[[str], Filter | None] | None = None):
        """temporary: close() deletes all files. filters: names a compaction filter for a keyspace's name, or None."""
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        self.poisoned = False
        self.temporary, self.filters = temporary, filters
        if not self.files.create("format.json", json.dumps({"format": FORMAT})):
            found = json.loads(self.files.read("format.json")).get("format")
            if found != FORMAT:
                raise errors.InvalidVersion(f"format {found}; this is version {FORMAT}")
        self._commits: list[dict] = []
        self.refresh()

    def close(self) -> None:
        if self.temporary:
            self.files.delete("")

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # State: the fold of all commits ------------------------------------------------

    def refresh(self) -> None:
        """Reads commits made since; a half-written draft is not among them.

        Every CHECKPOINT commits a file with all commits so far is written, so that opening reads few files.
        """
        if not self._commits and (made := self.files.list("checkpoints")):
            self._commits = json.loads(self.files.read(f"checkpoints/{made[-1]}"))
        for name in self.files.list("manifest")[len(self._commits) :]:
            self._commits.append(json.loads(self.files.read(f"manifest/{name}")))

    @property
    def seqno(self) -> int:
        """The next sequence number."""
        return self._commits[-1]["seqno"] + 1 if self._commits else 0

    @property
    def visible_seqno(self) -> int:
        return self.seqno

    def _catalogue(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for c in self._commits:
            for k in c.get("keyspaces", []):
                out[k["name"]] = k
            for name in c.get("dropped", []):
                out.pop(name, None)
        return out

    def _next_id(self) -> int:
        """One above the highest id ever given out: ids are never used again."""
        return max((k["id"] for c in self._commits for k in c.get("keyspaces", [])), default=0) + 1

    def _commit(self, seqno: int | None = None, **entry) -> int:
        if self.poisoned:
            raise errors.Poisoned("an earlier commit broke off")
        seqno = self.seqno if seqno is None else seqno
        try:
            made = self.files.create(f"manifest/{len(self._commits):020d}", json.dumps({"seqno": seqno, **entry}))
        except Exception:
            self.poisoned = True
            raise
        if not made:
            for f in [*entry.get("files", []), *entry.get("compacted", [])]:
                self.files.delete(f["path"])  # written for this commit, and named by none
            raise errors.Conflict("another writer made this commit first")
        self.refresh()
        if len(self._commits) % CHECKPOINT == 0:
            self.files.create(f"checkpoints/{len(self._commits):020d}", json.dumps(self._commits))
        return seqno

    # Keyspaces ------------------------------------------------------------------------

    def keyspace(self, name: str, key: str = "binary", value: str = "binary", **options) -> Keyspace:
        """Opens a keyspace, or creates it; options given for one that exists are ignored."""
        check_name(name)
        found = self._catalogue().get(name)
        if found is None:
            found = {"name": name, "id": self._next_id(), "key": key, "value": value, "options": options}
            self._commit(keyspaces=[found])
        return Keyspace(self, found)

    def delete_keyspace(self, ks: Keyspace) -> None:
        ks.check()
        self._commit(dropped=[ks.name])

    def keyspace_exists(self, name: str) -> bool:
        return name in self._catalogue()

    def list_keyspace_names(self) -> list[str]:
        return sorted(self._catalogue())

    def keyspace_count(self) -> int:
        return len(self._catalogue())

    def disk_space(self) -> int:
        return self.files.size("data")

    def journal_count(self) -> int:
        """Commits, each a file of the manifest."""
        return len(self._commits)

    def stats(self) -> DataFrame:
        """keyspace, id, commits, files and bytes on disk, and the time and number of compactions, one row for each keyspace."""
        rows = []
        for k in self._catalogue().values():
            files = self._live_files(k["id"])
            packed = [c["took"] for c in self._commits for f in c.get("compacted", []) if f["keyspace"] == k["id"]]
            rows.append((k["name"], k["id"], sum(any(f["keyspace"] == k["id"] for f in c.get("files", [])) for c in self._commits), len(files), sum(self.files.size(f["path"]) for f in files), len(packed), float(sum(packed))))
        return self.spark.createDataFrame(rows, "keyspace string, id long, commits long, files long, bytes long, compactions long, compaction_seconds double")

    # Snapshots and leases -----------------------------------------------------------------

    def snapshot(self, seconds: float = 3600.0) -> Snapshot:
        """Pins the present instant; its lease keeps compaction from what it can see until it expires."""
        self.refresh()
        return Snapshot(self, self.seqno, seconds)

    def watermark(self) -> int:
        """The lowest instant that must stay readable."""
        now, least = time.time(), self.seqno
        for name in self.files.list("leases"):
            lease = json.loads(self.files.read(f"leases/{name}"))
            if lease["expires"] > now:
                least = min(least, lease["instant"])
            else:
                self.files.delete(f"leases/{name}")
        return least

    # Writing ---------------------------------------------------------------------------------

    def batch(self) -> WriteBatch:
        return WriteBatch(self)

    def vacuum(self) -> list[str]:
        """Deletes data that no commit names (of broken-off, compacted or dropped writes). No writer may be at work."""
        used = {f["path"] for f in self._live_files()}
        gone = []
        for id_ in self.files.list("data"):
            for commit in self.files.list(f"data/{id_}"):
                if f"data/{id_}/{commit}" not in used:
                    gone.append(f"data/{id_}/{commit}")
                    self.files.delete(gone[-1])
        self.files.delete("drafts")
        return gone

    def _live_files(self, keyspace: int | None = None) -> list[dict]:
        alive = {k["id"] for k in self._catalogue().values()}
        out: dict[str, dict] = {}
        for c in self._commits:
            for r in c.get("replaced", []):
                out.pop(r, None)
            for f in [f | {"seqno": c["seqno"]} for f in c.get("files", [])] + c.get("compacted", []):
                out[f["path"]] = f
        return [f for f in out.values() if f["keyspace"] in alive and keyspace in (None, f["keyspace"])]


class Keyspace:
    def __init__(self, db: Database, entry: dict):
        self.db, self.entry = db, entry
        self.id, self.name = entry["id"], entry["name"]
        self.schema = f"key {entry['key']}, seqno long, batch_ord int, kind string, value {entry['value']}"

    @property
    def path(self) -> str:
        return f"{self.db.root}/data/{self.id}"

    def check(self) -> None:
        found = self.db._catalogue().get(self.name)
        if found is None or found["id"] != self.id:
            raise errors.KeyspaceDeleted(self.name)

    def raw(self, instant: int | None = None) -> DataFrame:
        """All log rows, clears too; files of commits at or after the instant are not opened."""
        files = [f["path"] for f in self.db._live_files(self.id) if instant is None or f["seqno"] < instant]
        reader = self.db.spark.read.schema(self.schema)
        rows = reader.parquet(*(f"{self.db.root}/{p}" for p in files)) if files else self.db.spark.createDataFrame([], self.schema)
        return rows.withColumn("keyspace_id", F.lit(self.id).cast("long"))

    def log(self, instant: int | None = None) -> DataFrame:
        """Log rows that the clears before the instant leave."""
        return drop_cleared(self.raw(instant), instant)

    # Reads at the latest instant, or at that of a snapshot.

    def iter(self, at: Snapshot | None = None, reverse: bool = False) -> DataFrame:
        return read.ordered(read.scan(self.log(_instant(at))), reverse)

    def range(self, bounds: Range, at: Snapshot | None = None, reverse: bool = False) -> DataFrame:
        return read.ordered(read.range_(self.log(_instant(at)), bounds), reverse)

    def prefix(self, start: str | bytes, at: Snapshot | None = None, reverse: bool = False) -> DataFrame:
        return read.ordered(read.prefix(self.log(_instant(at)), start), reverse)

    def get(self, key, at: Snapshot | None = None):
        row = read.get(self.log(_instant(at)), key).select("value").first()
        return None if row is None else _plain(row[0])

    def multi_get(self, keys: DataFrame, at: Snapshot | None = None) -> DataFrame:
        return read.multi_get(self.log(_instant(at)), keys)

    def contains_key(self, key, at: Snapshot | None = None) -> bool:
        return not read.get(self.log(_instant(at)), key, columns=()).isEmpty()

    def size_of(self, key, at: Snapshot | None = None) -> int | None:
        row = read.get(self.log(_instant(at)), key).select(F.octet_length("value")).first()
        return None if row is None else row[0]

    def first_key_value(self, at: Snapshot | None = None):
        return _pair(read.first(read.scan(self.log(_instant(at)))).first())

    def last_key_value(self, at: Snapshot | None = None):
        return _pair(read.last(read.scan(self.log(_instant(at)))).first())

    def len(self, at: Snapshot | None = None) -> int:
        return read.length(self.log(_instant(at))).first()[0]

    def approximate_len(self) -> int:
        return self.log().count()

    def is_empty(self, at: Snapshot | None = None) -> bool:
        """The newest row of all settles it if it is a value; only else are keys brought together."""
        log = self.log(_instant(at))
        newest = log.agg(F.max(F.struct("seqno", "batch_ord", "kind")).alias("m")).first()["m"]
        if newest is None or newest["kind"] == VALUE:
            return newest is None
        return read.scan(log, columns=()).isEmpty()

    def move_to(self, other: Keyspace, keys: list, at: Snapshot | None = None) -> int | None:
        """Moves items to another keyspace in one commit; absent keys are left out. One join finds them all."""
        wanted = self.db.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], f"key {self.entry['key']}")
        batch = self.db.batch()
        for key, value in rows_of(self.multi_get(wanted, at).select("key", "value")):
            batch.remove(self, key).insert(other, key, value)
        return batch.commit()

    def move_where(self, other: Keyspace, where: Column, at: Snapshot | None = None) -> int | None:
        """Moves all items for which a predicate on key and value holds, however many, in one commit."""
        moved = read.scan(self.log(_instant(at))).where(where).select("key", "value")
        return self.db.batch().insert_all(other, moved).remove_all(self, moved.select("key")).commit()

    def dequeue(self, n: int) -> list[tuple]:
        """Takes the first n items out, in key order, in one commit."""
        taken = rows_of(read.top(read.scan(self.log()), n))
        batch = self.db.batch()
        for key, _ in taken:
            batch.remove(self, key)
        batch.commit()
        return taken

    def is_kv_separated(self) -> bool:
        return bool(self.entry["options"].get("kv_separation"))

    def options(self) -> dict:
        """The options given at creation; they never change."""
        return dict(self.entry["options"])

    def disk_space(self) -> int:
        return sum(self.db.files.size(f["path"]) for f in self.db._live_files(self.id))

    # Writes: each a commit of its own.

    def insert(self, key, value) -> None:
        self.db.batch().insert(self, key, value).commit()

    def remove(self, key) -> None:
        self.db.batch().remove(self, key).commit()

    def remove_weak(self, key) -> None:
        self.db.batch().remove_weak(self, key).commit()

    def clear(self) -> None:
        self.db.batch().clear(self).commit()

    def ingest(self, items: DataFrame, kind: str = VALUE) -> None:
        """Bulk load of items (key, value) under one commit, dealt out by key ranges; repeated keys are refused."""
        self.check()
        seqno = self.db.seqno
        rows = checked(items).select("key", F.lit(seqno).cast("long").alias("seqno"), F.lit(0).alias("batch_ord"), F.lit(kind).alias("kind"), "value")
        path = f"data/{self.id}/{uuid.uuid4().hex}"
        rows.repartitionByRange("key").sortWithinPartitions("key").write.options(**WRITE).parquet(f"{self.db.root}/{path}")
        if not self.db.spark.read.parquet(f"{self.db.root}/{path}").groupBy("key").count().where("count > 1").isEmpty():
            raise ValueError("an ingestion holds each key once")
        self.db._commit(seqno, files=[{"keyspace": self.id, "path": path}])

    def fetch_update(self, key, change: Callable):
        """Sets the value to change(value or None), None deletes; returns the previous value."""
        return self._update(key, change)[0]

    def update_fetch(self, key, change: Callable):
        return self._update(key, change)[1]

    def take(self, key):
        return self._update(key, lambda _: None)[0]

    def _update(self, key, change: Callable):
        before = self.get(key)
        after = change(before)
        if after != before:
            batch = self.db.batch()
            (batch.remove(self, key) if after is None else batch.insert(self, key, after)).commit()
        return before, after

    # Maintenance.

    def major_compact(self, verdict: Callable[[Column, Column], Column] | None = None, replacement: Callable[[Column, Column], Column] | None = None) -> None:
        """Rewrites the keyspace without versions that no lease can see, through an optional filter.

        The filter judges (key, value) of live items below the watermark: keep, remove or replace; without
        one the database's own for this keyspace applies.
        """
        self.check()
        began = time.time()
        if verdict is None and self.db.filters is not None and (named := self.db.filters(self.name)) is not None:
            verdict, replacement = named.verdict, named.replacement
        mark = self.db.watermark()
        old = self.db._live_files(self.id)
        rows = maintain.compact(self.raw(), mark, ("keyspace_id",))
        if verdict is not None:
            below = F.col("seqno") < mark
            judged = F.when(below & (F.col("kind") == VALUE), verdict(F.col("key"), F.col("value")))
            rows = maintain.apply_filter(rows, judged, replacement(F.col("key"), F.col("value")) if replacement else None)
        rows = rows.select("key", "seqno", "batch_ord", "kind", "value")
        path = f"data/{self.id}/{uuid.uuid4().hex}"
        rows.repartitionByRange("key", "seqno").sortWithinPartitions("key", F.desc("seqno")).write.options(**WRITE).parquet(f"{self.db.root}/{path}")
        # The rewritten file holds old seqnos: it takes the place of the first file, so that snapshots open it.
        first = min((f["seqno"] for f in old), default=0)
        self.db._commit(self.db.seqno, files=[], replaced=[f["path"] for f in old], compacted=[{"keyspace": self.id, "path": path, "seqno": first}], took=time.time() - began)


class Snapshot:
    """An instant of all keyspaces; use it as a context manager or close it."""

    def __init__(self, db: Database, instant: int, seconds: float):
        self.db, self.instant = db, instant
        self.lease = f"leases/{uuid.uuid4().hex}"
        db.files.create(self.lease, json.dumps({"instant": instant, "expires": time.time() + seconds}))

    def seqno(self) -> int:
        return self.instant

    def clone(self, seconds: float = 3600.0) -> Snapshot:
        """Another lease of the same instant."""
        return Snapshot(self.db, self.instant, seconds)

    def close(self) -> None:
        self.db.files.delete(self.lease)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class WriteBatch:
    """Writes to several keyspaces that become visible together, in order; all share one sequence number."""

    def __init__(self, db: Database):
        self.db, self.rows = db, []
        self.frames: list[tuple[Keyspace, str, DataFrame]] = []

    def __len__(self) -> int:
        return len(self.rows)

    def is_empty(self) -> bool:
        return not self.rows and not self.frames

    def _add(self, ks: Keyspace, kind: str, key, value) -> WriteBatch:
        if kind != CLEAR:
            check_key(key)
        self.rows.append((ks, len(self.rows), kind, key, value))
        return self

    def insert(self, ks: Keyspace, key, value) -> WriteBatch:
        return self._add(ks, VALUE, key, value)

    def remove(self, ks: Keyspace, key) -> WriteBatch:
        return self._add(ks, TOMBSTONE, key, None)

    def remove_weak(self, ks: Keyspace, key) -> WriteBatch:
        return self._add(ks, WEAK, key, None)

    def clear(self, ks: Keyspace) -> WriteBatch:
        """Empties the keyspace; what the batch writes to it later stays."""
        return self._add(ks, CLEAR, None, None)

    def insert_all(self, ks: Keyspace, items: DataFrame) -> WriteBatch:
        """Adds a DataFrame (key, value) of any size; frames come after the single writes, in the order of the calls."""
        self.frames.append((ks, VALUE, checked(items)))
        return self

    def remove_all(self, ks: Keyspace, keys: DataFrame) -> WriteBatch:
        """Removes the keys of a DataFrame (key) of any size."""
        self.frames.append((ks, TOMBSTONE, checked(keys).withColumn("value", F.lit(None).cast(ks.entry["value"]))))
        return self

    def commit(self, touched: list | None = None) -> int | None:
        """Writes the rows and publishes them; touched: keys that the commit counts as written, for conflict checks."""
        if self.is_empty() and not touched:
            return None
        seqno, spark = self.db.seqno, self.db.spark
        held = {k.id: k for k in [*(r[0] for r in self.rows), *(f[0] for f in self.frames)]}
        for ks in held.values():
            ks.check()
        files = []
        for id_, ks in held.items():
            mine = [r for r in self.rows if r[0].id == id_]
            df = spark.createDataFrame([(key, seqno, n, kind, value) for _, n, kind, key, value in mine], ks.schema).coalesce(1)
            for n, (other, kind, items) in enumerate(self.frames, len(self.rows)):
                if other.id == id_:
                    df = df.unionByName(items.select("key", F.lit(seqno).cast("long").alias("seqno"), F.lit(n).alias("batch_ord"), F.lit(kind).alias("kind"), "value"))
            path = f"data/{id_}/{uuid.uuid4().hex}"
            df.sortWithinPartitions("key").write.options(**WRITE).parquet(f"{self.db.root}/{path}")
            files.append({"keyspace": id_, "path": path})
        return self.db._commit(seqno, files=files, **({} if touched is None else {"touched": touched}))


def checked(items: DataFrame) -> DataFrame:
    """items whose keys have a length that is allowed; the job that reads another one fails."""
    n = F.coalesce(F.octet_length(F.col("key")), F.lit(0))
    wrong = F.raise_error(F.format_string(f"a key has 1 to {MAX_KEY} bytes, not %d", n)).cast(items.schema["key"].dataType)
    return items.withColumn("key", F.when((n > 0) & (n <= MAX_KEY), F.col("key")).otherwise(wrong))


def _instant(at: Snapshot | None) -> int | None:
    return None if at is None else at.instant


def _plain(x):
    return bytes(x) if isinstance(x, bytearray) else x


def _pair(row):
    return None if row is None else (_plain(row["key"]), _plain(row["value"]))


def rows_of(df: DataFrame) -> Iterable[tuple]:
    """(key, value) pairs of a small result, for tests and shells."""
    return [(_plain(r["key"]), _plain(r["value"])) for r in df.collect()]
