"""Token ids in a content-addressed store.

Texts are encoded once; a rolling hash over the ids cuts each document into
chunks; a chunk is stored once under the hash of its contents; a document is a
recipe, the list of its chunks; Merkle roots over chunk hashes (document),
document roots (part of a recipe file), part roots (file) and file roots
(manifest) verify a reconstruction.

Layout of a store:
  chunks/    sha (16 bytes), n (ids), payload (zstd of little-endian 16- or 32-bit ids), spread by sha
  recipes/   doc_id, start, n_tokens, shas (concatenated), root, file, part; ascending by doc_id
  manifest/  one row for each recipe file: file, first and last document, start, ids, Merkle root

The id stream is the concatenation of the documents in ascending doc_id order;
`start` is a document's place in it.

Edge cases: a null text is an empty one and holds the end id alone; repeated
doc_ids stay separate rows, ordered among themselves by their root (rows that agree in
both are equal); null ids come first; a text of any length is one document of many
chunks; columns other than the two named are not looked at; an empty table gives an
empty store.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _scratch
from . import _words as W

END_ID = 1
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 128, 1024, 8192
PART = 1 << 16  # documents under one Merkle root below that of their file
_ROLL = 16  # ids under the rolling hash
_TABLE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 1 << 16, dtype=np.uint64)
_MEMO = 1_000_000  # distinct words that a worker remembers, some 50 bytes each
_SEEN = 1 << 17  # chunk names that a task remembers


class Memo:
    """Ids of words by the words' 64-bit hashes, in flat arrays; emptied when full."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is held."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """h ascending, none of them held."""
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        place = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, place, h)
        self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Ids of texts; words between ASCII white space are encoded once while they are remembered.

    The tokenizer must split at ASCII white space and drop it, take ASCII letters in either case for
    the same and split a full stop or comma from letters before it, so that a text's ids are those of
    its words; this is tried with a probe, and texts are encoded whole if it fails.
    """

    def __init__(self, path: str, most: int = _MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already run side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo(most)
        probe = ["Ab, cd.\n\tEf's gh\x0b12  Ünï <|x|>. it.", " a\r\nb ", "A.B,C d,. x12."]
        try:
            self.by_word = True
            for text, (ids, _) in ((p, self.encode(t)) for p in probe for _, t in W.parts(pa.array([p]))):
                self.by_word &= ids.tolist() == [*self._many([text])[0], END_ID]
        finally:
            self.memo.clear()

    def _many(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, t: W.Text) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with END_ID after each text, and the bounds of the texts."""
        if not self.by_word:
            raw = t.raw.tobytes()
            each = [np.array([*x, END_ID], np.uint32) for x in self._many([raw[t.off[i] : t.off[i + 1]].decode() for i in range(t.n)])]
            return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        if b"<|" not in t.raw.tobytes():  # special tokens are told apart by case
            t = t.lower()
        row, start, stop = t.words(W.NOT_SPACE)
        if len(row):
            # A full stop or comma after an ASCII letter is a piece of its own.
            tail = (stop - start > 1) & _TAIL[t.bytes[stop - 1]] & _LETTER[t.bytes[stop - 2]]
            twice = 1 + tail
            row, end, begin = np.repeat(row, twice), np.repeat(stop, twice), np.repeat(start, twice)
            second = np.cumsum(twice)[tail] - 1
            begin[second] = end[second] - 1
            end[second - 1] -= 1
            start, stop = begin, end
        h, first, which = np.unique(t.hashes(start, stop), return_index=True, return_inverse=True)
        if len(self.memo.hashes) + len(h) > self.memo.most:
            self.memo.clear()
        _, held = self.memo.find(h)
        data, new = t.bytes.tobytes(), np.flatnonzero(~held)
        words = [data[a:b].decode() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)]
        if words:
            self.memo.add(h[new], self._many(words))
        place, _ = self.memo.find(h)
        size, at = self.memo.size[place].astype(np.int64), self.memo.at[place]
        count = size[which] if len(which) else np.zeros(0, np.int64)
        n = np.bincount(row, weights=count, minlength=t.n).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.full(bounds[-1], END_ID, np.uint32)
        if len(which):
            every = np.arange(count.sum())
            inner = every - np.repeat(np.cumsum(count) - count, count)
            out[every + np.repeat(row, count)] = self.memo.flat[np.repeat(at[which], count) + inner]
        return out, bounds


_TAIL, _LETTER = W.byte_set(".,"), np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer: tasks of one Python worker share its memory."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document, where its chunks end (the last is its own end).

    A place is a candidate if the sum of the table's values of the last _ROLL ids, mixed, is 0
    modulo MEAN_CHUNK; chunks are MIN_CHUNK to MAX_CHUNK ids long, the last may be shorter.
    """
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[ids & 0xFFFF], dtype=np.uint64)])
    place = np.arange(_ROLL, len(ids) + 1)
    hit = place[(W.mix(sums[_ROLL:] - sums[:-_ROLL]) & np.uint64(MEAN_CHUNK - 1)) == 0] if len(ids) >= _ROLL else place[:0]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, at = [], lo
        if hi - lo > MIN_CHUNK:
            near = hit[np.searchsorted(hit, lo + max(MIN_CHUNK, _ROLL)) : np.searchsorted(hit, hi)].tolist()
            for h in [*near, hi]:
                while h - at > MAX_CHUNK:
                    at += MAX_CHUNK
                    ends.append(at)
                if h - at >= MIN_CHUNK and h < hi:
                    at = h
                    ends.append(at)
        if at < hi:
            ends.append(hi)
        out.append(ends)
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node goes up unchanged."""
    level = hashes or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def pack(ids: np.ndarray) -> bytes:
    """The stored form of a chunk before compression: width in bytes, then the ids."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" + ids.astype("<u4").tobytes()) if wide else (b"\2" + ids.astype("<u2").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] == 4 else "<u2", offset=1).astype("<u4")


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(b"\0" + data, digest_size=16).digest()


def _encode(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """A row for each document (its recipe) and one for each chunk that is new to the task."""

    def run(batches):
        import zstandard

        encode, squeeze, seen = encoder(path).encode, zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            for lo, t in W.parts(b.column(1)):
                ids, bounds = encode(t)
                doc_ids = b.column(0).slice(lo, t.n).to_pylist()
                rows: list[tuple] = []
                if len(seen) > _SEEN:
                    seen.clear()
                for d, ends in enumerate(cuts(ids, bounds)):
                    at, shas = int(bounds[d]), []
                    for end in ends:
                        data = pack(ids[at:end])
                        sha = name_of(data)
                        shas.append(sha)
                        if sha not in seen:
                            seen.add(sha)
                            rows.append((None, sha, end - at, squeeze.compress(data), None))
                        at = end
                    rows.append((doc_ids[d], b"".join(shas), int(bounds[d + 1] - bounds[d]), None, merkle(shas)))
                a, s, n, p, m = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, b.schema.field(0).type), pa.array(s, pa.binary()), pa.array(n, pa.int64()), pa.array(p, pa.binary()), pa.array(m, pa.binary())], [id_col, "sha", "n", "payload", "root"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(W.lean(run), f"`{id_col}` {kind}, sha binary, n long, payload binary, root binary")


def save(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of docs under path, a folder that all executors reach."""
    spark = docs.sparkSession
    raw = _scratch.write(_encode(docs, id_col, text_col, tokenizer), "encoded", compression="none")
    # Most chunks came from one task only and are written without a shuffle; of the others one copy is kept.
    chunks = raw.where("payload is not null").select("sha", "n", "payload")
    shared = _scratch.write(chunks.groupBy("sha").agg(F.count("*").alias("c")).where("c > 1").select("sha"), "shared")
    once = _scratch.by_ids(chunks, "sha", shared, "left_anti")
    again = _scratch.by_ids(chunks, "sha", shared, "left_semi").dropDuplicates(["sha"])
    once.unionByName(again).write.option("compression", "none").parquet(f"{path}/chunks")
    _scratch.drop(shared)
    # Recipes in ascending order. The range exchange is written down before places are summed up,
    # so that all that follows sees the same files.
    recipe = raw.where("payload is null").select(F.col(id_col).alias("doc_id"), F.col("n").alias("n_tokens"), F.col("sha").alias("shas"), "root")
    staged = _scratch.write(recipe.repartitionByRange("doc_id", "root").withColumn("file", F.spark_partition_id()), "recipes")
    _scratch.drop(raw)
    # One row for each file: bounded by the number of partitions.
    files = staged.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows, start = [], 0
    for f in sorted(files.collect(), key=lambda r: r["file"]):
        rows.append((*f[:4], start, f["n_tokens"]))
        start += f["n_tokens"]
    kind = staged.schema["doc_id"].dataType.simpleString()
    places = spark.createDataFrame(rows, f"file int, first {kind}, last {kind}, n_docs long, start long, n_tokens long")
    order = Window.partitionBy("file").orderBy("doc_id", "root")
    placed = staged.withColumn("inner", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("part", F.floor((F.row_number().over(order) - 1) / PART).cast("int"))
    placed = placed.join(F.broadcast(places.select("file", F.col("start").alias("base"))), "file")
    placed.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "shas", "root", "file", "part").write.option("compression", "zstd").parquet(f"{path}/recipes")
    by_file = _file_roots(spark.read.parquet(f"{path}/recipes"))
    root = spark.createDataFrame(list(by_file.items()), "file int, root binary")
    places.join(F.broadcast(root), "file").coalesce(1).write.parquet(f"{path}/manifest")
    _scratch.drop(staged)


def _file_roots(recipes: DataFrame) -> dict[int, bytes]:
    """Merkle root of each recipe file, over the roots of its parts: no group is larger than PART documents."""
    roots = recipes.groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("start", "root"))).alias("r"))
    roots = roots.select("file", "part", F.transform("r", lambda x: x["root"]).alias("r")).mapInArrow(_part_roots, "file int, part int, root binary")
    by_file: dict[int, list[bytes]] = {}
    for f, _, r in sorted((x["file"], x["part"], bytes(x["root"])) for x in roots.collect()):
        by_file.setdefault(f, []).append(r)
    return {f: merkle(r) for f, r in by_file.items()}


def _part_roots(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([merkle(r) for r in b.column(2).to_pylist()], pa.binary())], ["file", "part", "root"])


def manifest_root(spark: SparkSession, path: str) -> bytes:
    """Root of the whole store: the Merkle root over the recipe files in order."""
    return merkle([bytes(r["root"]) for r in spark.read.parquet(f"{path}/manifest").orderBy("file").collect()])


@functools.lru_cache(1 << 16)
def _shift(n: int) -> int:
    """x**(8 n) modulo the CRC-32 polynomial, bits reflected."""
    out, power, n = 0x80000000, 0x00800000, n
    while n:
        if n & 1:
            out = _times(out, power)
        power = _times(power, power)
        n >>= 1
    return out


def _times(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two strings put together, the second of n_bytes."""
    return _times(first, _shift(n_bytes)) ^ second


def _check_chunks(batches):
    import zstandard

    squeeze = zstandard.ZstdDecompressor()
    for b in batches:
        shas, crcs = b.column(0).to_pylist(), []
        for sha, n, payload in zip(shas, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = squeeze.decompress(payload)
            if name_of(data) != sha:
                raise ValueError(f"chunk {sha.hex()} does not have the contents it is named for")
            ids = unpack(data)
            if len(ids) != n:
                raise ValueError(f"chunk {sha.hex()} holds {len(ids)} ids, not {n}")
            crcs.append(zlib.crc32(ids.tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["sha", "n", "crc"])


def _recipe_chunks(path: str, spark: SparkSession, chunks: DataFrame, *columns: str) -> DataFrame:
    """Each document with its chunks in order; `start` tells rows apart, as each holds an id at least."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode(F.expr("transform(sequence(0, int(octet_length(shas) / 16) - 1), i -> substring(shas, i * 16 + 1, 16))")).alias("seq", "sha"))
    joined = parts.join(chunks, "sha", "left")
    return joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("seq", "sha", *columns))).alias("c"))


def verify(spark: SparkSession, path: str) -> None:
    """Holds the recipes against the manifest: each file's Merkle root, documents, ids and place in the stream."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    roots = _file_roots(recipes)
    # One row for each file: bounded by the number of partitions.
    files = recipes.groupBy("file").agg(F.count("*"), F.sum("n_tokens"), F.min("start"), F.max(F.col("start") + F.col("n_tokens")))
    found = {f: (n, ids, start, end, roots[f]) for f, n, ids, start, end in files.collect()}
    named, at = {}, 0
    for r in manifest.orderBy("file").collect():
        if r["start"] != at:
            raise ValueError(f"file {r['file']} begins at id {r['start']}, not {at}")
        at += r["n_tokens"]
        named[r["file"]] = (r["n_docs"], r["n_tokens"], r["start"], at, bytes(r["root"]))
    for f in named.keys() | found.keys():
        if named.get(f) != found.get(f):
            raise ValueError(f"the recipes of file {f} do not agree with the manifest")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids of each document, from the files of the store.

    The recipes are held against the manifest first; then every chunk is decompressed and held
    against its name, every document against its Merkle root.
    """
    verify(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks").select("sha", "n", "payload").mapInArrow(W.lean(_check_chunks), "sha binary, n long, crc long")

    def run(batches):
        for b in batches:
            starts, ids, ns, roots, c = (b.column(i).to_pylist() for i in range(5))
            crcs = []
            for start, n, root, parts in zip(starts, ns, roots, c, strict=True):
                if any(p["n"] is None for p in parts) or sum(p["n"] for p in parts) != n or merkle([p["sha"] for p in parts]) != root:
                    raise ValueError(f"the document at {start} does not agree with its recipe")
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = crc_join(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = _recipe_chunks(path, spark, chunks, "n", "crc").select("start", "doc_id", "n_tokens", "root", "c")
    return out.mapInArrow(W.lean(run), f"doc_id {out.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids of each document, rebuilt from its chunks."""

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdDecompressor()
        for b in batches:
            each = [np.concatenate([unpack(squeeze.decompress(p["payload"])) for p in parts]).astype(np.int64) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array([x.tolist() for x in each], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    out = _recipe_chunks(path, spark, spark.read.parquet(f"{path}/chunks").select("sha", "payload"), "payload").select("start", "doc_id", "c")
    return out.mapInArrow(run, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, start long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Saves docs and returns the digests that are read back; without a path the store is deleted when they have been read."""
    spark = docs.sparkSession
    since, own = _scratch.mark(), path is None
    path = path or f"{_scratch.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    save(docs, path, tokenizer, id_col, text_col)
    _scratch.tidy(spark)
    if not own:
        return digests(spark, path)
    try:
        out = _scratch.write(digests(spark, path), "digests")
    finally:
        _scratch.delete(spark, path)
    _scratch.release(since, out)
    return out
