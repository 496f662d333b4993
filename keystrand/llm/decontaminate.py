"""Benchmark decontamination with suffix arrays over shards of the training text.

Every block of documents is a shard.  Its words become ids of the benchmark's
vocabulary (0: a word that no item has, or the end of a document), and a suffix
array is built over the positions whose suffix can match at all, that is whose
run of known words is as long as the shortest window.  All suffixes of all items
are then looked up by binary search; the interval of a suffix at window depth
holds the places where the window occurs, and comparing onwards from there
gives the longest verbatim match at each place.

Nothing is shuffled: a shard is what one task reads at once, and whole documents
lie in one shard.  The benchmark is sent to the executors in blocks of at most
`block_bytes` of text, one pass over the documents for each block, so what is
broadcast does not grow; places found are handed on from pass to pass.

Edge cases: null texts and items have no words; an item without words is never
found; items that share an id are one item; null ids are ids; an empty benchmark
flags nothing; an empty documents table gives an empty table; repeated rows are
reported row by row, whatever the benchmark's size; ties do not arise; a text of any
length is one part of one shard; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _words as W

WINDOW = 10
BLOCK_BYTES = 32 << 20
_SORTED_WORDS = 64  # depth to which a suffix array is ordered; longer matches are compared word by word
_PACK = 4  # ids of 16 bits in one key, or 2 of 32 bits

COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string"


class Benchmark:
    """Items as word ids, and all their suffixes."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        t = next((t for _, t in W.parts(pa.array(texts, pa.large_string()), 1 << 62)), None)
        row, start, stop = t.lower().words(W.ALNUM) if t else (np.zeros(0, np.int64),) * 3
        h = t.hashes(start, stop) if t else np.zeros(0, np.uint64)
        self.window = window
        self.item_ids = list(ids)
        self.vocabulary = np.unique(h)
        self.words = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
        self.item = row
        length = np.bincount(row, minlength=len(self.item_ids))
        self.first = np.concatenate([[0], np.cumsum(length)])
        self.last = self.first[row + 1] if len(row) else np.zeros(0, np.int64)
        self.need = np.minimum(length, window)[row] if len(row) else np.zeros(0, np.int64)
        # Suffixes at least as long as the window of their item.
        self.suffix = np.flatnonzero(self.last - np.arange(len(row)) >= self.need)
        self.least = int(self.need.min()) if len(row) else 0
        self.bits = 16 if len(self.vocabulary) < 65535 else 32

    def encode(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary) or not len(h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


class Shard:
    """Word ids of some documents and their suffix array."""

    def __init__(self, t: W.Text, bench: Benchmark):
        row, start, stop = t.lower().words(W.ALNUM)
        self.n_words = np.bincount(row, minlength=t.n)
        self.bench = bench
        self.row = row
        # A 0 after each document ends every match.
        self.slot = np.arange(len(row)) + row
        self.first = np.concatenate([[0], np.cumsum(self.n_words)]) + np.arange(t.n + 1)
        pad = _SORTED_WORDS + bench.window + 1
        self.ids = np.zeros(len(row) + t.n + pad, np.int64)
        self.ids[self.slot] = bench.encode(t.hashes(start, stop))
        known = self.ids > 0
        # Known words from each place on: distance to the next 0.
        stops = np.flatnonzero(~known)
        place = np.flatnonzero(known)
        run = stops[np.searchsorted(stops, place)] - place
        keep = place[run >= max(1, bench.least)] if bench.least else place[:0]
        self.per_key = 64 // bench.bits
        depth = min(_SORTED_WORDS, max(bench.window, int(run.max(initial=0))))
        self.keys = []
        for k in range(0, depth, self.per_key):
            key = np.zeros(len(keep), np.uint64)
            for j in range(self.per_key):
                key = key << np.uint64(bench.bits) | self.ids[keep + k + j].astype(np.uint64)
            self.keys.append(key)
        order = np.lexsort(self.keys[::-1]) if len(keep) else np.zeros(0, np.int64)
        self.suffix_array = keep[order]
        self.keys = [k[order] for k in self.keys]

    def _bisect(self, key: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """First place in each [lo, hi) of key whose value is not below (right: is above) want."""
        lo, hi = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            up = key[mid] <= want[live] if right else key[mid] < want[live]
            lo[live[up]] = mid[up] + 1
            hi[live[~up]] = mid[~up]
        return lo

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix of the benchmark, first, end): where in the suffix array the suffix's window occurs, if it does."""
        b, bits = self.bench, self.bench.bits
        at = b.suffix
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffix_array))
        padded = np.concatenate([b.words, np.zeros(self.per_key + b.window, np.int64)])
        for k, key in enumerate(self.keys):
            if k * self.per_key >= b.window:
                break
            low, high = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
            for j in range(self.per_key):
                depth = k * self.per_key + j
                inside = depth < b.need[at]
                word = padded[at + depth].astype(np.uint64)
                low = low << np.uint64(bits) | np.where(inside, word, np.uint64(0))
                high = high << np.uint64(bits) | np.where(inside, word, np.uint64((1 << bits) - 1))
            live = np.flatnonzero(lo < hi)
            at, low, high, lo, hi = at[live], low[live], high[live], lo[live], hi[live]
            lo = self._bisect(key, low, lo, hi, False)
            hi = self._bisect(key, high, lo, hi, True)
        live = hi > lo
        return at[live], lo[live], hi[live]

    @staticmethod
    def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For groups of n members each: the group and the number in it of every member."""
        return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def find(self) -> tuple[np.ndarray, np.ndarray]:
        """(suffix of the benchmark, place in the shard) of every occurrence."""
        at, lo, hi = self.intervals()
        which, inner = self._spread(hi - lo)
        return at[which], self.suffix_array[lo[which] + inner]

    def longest(self, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words in which the suffix and the text agree from place on."""
        b = self.bench
        length = b.need[suffix].copy()
        live = np.arange(len(suffix))
        while len(live):
            more = suffix[live] + length[live] < b.last[suffix[live]]
            live = live[more]
            live = live[b.words[suffix[live] + length[live]] == self.ids[place[live] + length[live]]]
            length[live] += 1
        return length

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word lies in an occurrence of a window; distinct (document, item) pairs, as document * items + item.

        Suffixes of several items that begin with one window share an interval: its places are gone
        through once, and its distinct documents meet its distinct items.
        """
        at, lo, hi = self.intervals()
        size = max(1, len(self.suffix_array))
        # The end belongs to the key, as a short item's window is part of longer ones' intervals.
        key, first, which = np.unique(lo * (size + 1) + hi, return_index=True, return_inverse=True)
        lo, n, need = lo[first], (hi - lo)[first], self.bench.need[at]
        longest = np.zeros(len(key), np.int64)
        np.maximum.at(longest, which, need)
        group, inner = self._spread(n)
        place = self.suffix_array[lo[group] + inner]
        edge = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + longest[group], -1)
        docs = np.unique(group * (len(self.first) + 1) + self.document(place))
        items = np.unique(which * max(1, len(self.bench.item_ids)) + self.bench.item[at])
        of, item = np.divmod(items, max(1, len(self.bench.item_ids)))
        of_doc, doc = np.divmod(docs, len(self.first) + 1)
        begin, end = np.searchsorted(of, of_doc), np.searchsorted(of, of_doc, "right")
        each, inner = self._spread(end - begin)
        return np.cumsum(edge)[self.slot] > 0, np.unique(doc[each] * max(1, len(self.bench.item_ids)) + item[begin[each] + inner])


def _digest(items: list) -> tuple[str, str]:
    joined = ",".join(sorted(set(items)))
    return hashlib.sha256(joined.encode()).hexdigest(), joined


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists (ids, texts) of at most block_bytes of text or one item; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(r[1].encode())
        if ids and size + n > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    yield ids, texts


_STATE = "places array<array<long>>, found array<string>"


def _runs(s: Shard, hit: np.ndarray, n: int) -> list[list]:
    """[first, end) of the runs of hit words of each document, in its own words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    base = np.concatenate([[0], np.cumsum(s.n_words)])
    out: list[list] = [[] for _ in range(n)]
    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while x < y:  # a run of hits may go over from one document to the next
            d = int(s.row[x])
            z = min(y, int(base[d + 1]))
            out[d].append([x - int(base[d]), z - int(base[d])])
            x = z
    return out


def _pass(docs: DataFrame, bench, last: bool) -> DataFrame:
    """One pass of one block over docs (id, text, places and items found so far): the same rows with more of both, or (last) the report's columns."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        b_ = bench.value
        for b in batches:
            for lo, t in W.parts(b.column(1)):
                s = Shard(t, b_)
                hit, pairs = s.hits()
                part = b.slice(lo, t.n)
                before, found = part.column(2).to_pylist(), part.column(3).to_pylist()
                base = np.concatenate([[0], np.cumsum(s.n_words)]).tolist()
                for d, runs in enumerate(before):
                    for x, y in runs:
                        hit[base[d] + x : base[d] + y] = True
                for p in pairs.tolist():
                    found[p // len(b_.item_ids)].append(str(b_.item_ids[p % len(b_.item_ids)]))
                if not last:
                    places = pa.array(_runs(s, hit, t.n), pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), places, pa.array([sorted(set(x)) for x in found], pa.list_(pa.string()))], ["id", "text", "places", "found"])
                    continue
                n_hit = np.bincount(s.row[hit], minlength=t.n)
                sha, joined = zip(*map(_digest, found), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s.n_words), pa.array(n_hit), pa.array([len(set(x)) for x in found], pa.int64()), pa.array(sha), pa.array(n_hit > 0), pa.array(joined)], ["id", *names]
                )

    return docs.mapInArrow(W.lean(run), f"id {kind}, {COLUMNS}" if last else f"id {kind}, text string, {_STATE}")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: words, hit words, items and their digest.

    Each block of the benchmark is one pass, which hands the rows on with what was found so far.
    """
    spark = docs.sparkSession
    none = [F.array().cast(x.split(" ", 1)[1]).alias(x.split(" ", 1)[0]) for x in _STATE.split(", ")]
    rows, held, state = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *none), None, None
    for ids, texts in blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:
            new = _scratch.write(_pass(rows, held, False), "found")
            held.unpersist(blocking=False)
            if state is not None:
                _scratch.drop(state)
            rows = state = new
        held = spark.sparkContext.broadcast(Benchmark(ids, texts, window))
    return _pass(rows, held, True).withColumnRenamed("id", id_col)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches: item, first word in the item, document, first word in the document, words.

    A match is given where it cannot be extended to the left.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    out = None
    for ids, texts in blocks(benchmark, item_col, item_text_col, block_bytes):
        bench = spark.sparkContext.broadcast(Benchmark(ids, texts, window))

        def run(batches, bench=bench):
            b_ = bench.value
            for b in batches:
                for lo, t in W.parts(b.column(1)):
                    s = Shard(t, b_)
                    suffix, place = s.find()
                    n = s.longest(suffix, place)
                    head = (suffix == b_.first[b_.item[suffix]]) | (place == 0)
                    head |= b_.words[suffix - 1] != s.ids[place - 1]
                    suffix, place, n = suffix[head], place[head], n[head]
                    d = s.document(place)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b_.item_ids[i] for i in b_.item[suffix]]), pa.array(suffix - b_.first[b_.item[suffix]]), b.column(0).slice(lo, t.n).take(pa.array(d)), pa.array(place - s.first[d]), pa.array(n)],
                        ["item", "item_word", "doc", "doc_word", "n_words"],
                    )

        one = docs.select(id_col, text_col).mapInArrow(W.lean(run), f"item {item_kind}, item_word long, doc {kind}, doc_word long, n_words long")
        out = one if out is None else out.unionAll(one)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no window of any item; each block's pass leaves fewer for the next."""
    k, held, state = docs.columns.index(text_col), None, None

    def clean(rows: DataFrame, bench) -> DataFrame:
        def run(batches):
            for b in batches:
                for lo, t in W.parts(b.column(k)):
                    s = Shard(t, bench.value)
                    dirty = np.zeros(t.n, bool)
                    dirty[s.document(s.find()[1])] = True
                    yield b.slice(lo, t.n).filter(pa.array(~dirty))

        return rows.mapInArrow(W.lean(run), rows.schema)

    for ids, texts in blocks(benchmark, item_col, item_text_col, block_bytes):
        if held is not None:
            new = _scratch.write(clean(docs, held), "clean")
            held.unpersist(blocking=False)
            if state is not None:
                _scratch.drop(state)
            docs = state = new
        held = docs.sparkSession.sparkContext.broadcast(Benchmark(ids, texts, window))
    return clean(docs, held)
