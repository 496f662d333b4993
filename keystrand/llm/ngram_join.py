"""Jaccard join of documents on word shingles by T-occurrence search (DivideSkip).

A document's set is its distinct k-word shingles (52-bit hashes).  Two sets of a
and b shingles link when their intersection reaches T = ceil(t (a + b) / (1 + t)).

* Divide.  The shingles of all sets stand in one order: first those whose inverted
  lists are short, then the long ones (of shingles that many sets hold).  A set of n
  leaves out its last L = ceil(t n) - 1 lists, which are fewer than any partner
  must share, and merges the others.  Which lists count as long only decides the work.
* Merge.  The postings of each merged list are brought together by a shuffle
  that sorts by list; lists with the same members are one.  A list is dealt into
  blocks of at most `BLOCK` members, with a few pivots of the list in every block, so
  no list has to fit one task.  With so many lists left out, one occurrence in the
  merged ones makes a candidate.
* Skip.  Of the candidates in a block that a size bound and a bound on the symmetric
  difference (parity bitmaps) leave, a spanning forest is proposed, nearest
  pairs first; pairs within one component are never listed.  For a proposed pair the
  short lists of the smaller set are merged with those of the larger; if the
  occurrences and the number of its long lists reach T together, the long lists are
  probed, by binary search for their shingles in the larger set, which asks of each
  list whether it holds that set.  The pair links if T is reached.
* Rounds.  Verified links are contracted to components and refused pairs are
  remembered.  A list of one block all of whose proposals link is settled.  The
  others propose again: each member its nearest partners in other components,
  against all that are outside the list's largest component.  The end is
  reached when no list proposes a pair: then every two linked sets share a
  component.  No pair is capped or sampled away.

Copies with equal sets are one member.  No links, components or sets are
collected to the driver; what is broadcast is bounded (the long lists' hashes,
and ids up to a checked number).

Edge cases: null or empty texts and texts without words have an empty set and
are linked with nothing; fewer than k words form one shingle; rows that repeat
an id are one node; a null id has a null component; a text of any length is one set;
columns other than the two named are not looked at by join() and passed through by
deduplicate(), whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _words as W

SHINGLE, PERCENT = 3, 90
LONG = 64  # sets that hold a shingle, from which on its list is long
MOST_LONG = 2_000_000  # long lists that are broadcast (16 MB); beyond, the longest
BLOCK, PIVOTS = 512, 32
TRIES = 8  # partners that a member proposes in a later round
BITS = 1024  # least width of a parity bitmap
#: Hashes are this wide, so that a row of a block, the kind of list and the hash fit 64 bits.
HASH_BITS, ROWS = 52, 2048

_SALT = np.uint64(0xD6E8FEB86659FD93)


def shingles(t: W.Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles, repeated ones too."""
    row, start, stop = t.lower().words(W.NOT_SPACE)
    h = t.hashes(start, stop)
    at, g = W.grams(h, row, k)
    r = row[at]
    count = np.bincount(row, minlength=t.n)
    short = np.flatnonzero((count[row] < k)) if len(row) else row
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        place = short - first[row[short]]
        whole = np.zeros(t.n, np.uint64)
        np.add.at(whole, row[short], h[short] * W.GRAM[place])
        rows = np.unique(row[short])
        r, g = np.concatenate([r, rows]), np.concatenate([g, W.mix(whole[rows] + count[rows].astype(np.uint64) * _SALT)])
    return r, g >> np.uint64(64 - HASH_BITS)


def shingle_sets(t: W.Text, k: int, long: LongLists | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of distinct shingles, ascending by row, then short lists first, then by hash.

    Row, list kind and hash are sorted as one number.
    """
    r, g = shingles(t, k)
    key = r.astype(np.uint64) << np.uint64(HASH_BITS + 1) | g
    if long is not None:
        key |= long.holds(g).astype(np.uint64) << np.uint64(HASH_BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(HASH_BITS + 1)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1)


class LongLists:
    """The hashes of long lists, with a table of their upper bits in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.hashes >> np.uint64(HASH_BITS - 20)] = True

    def holds(self, g: np.ndarray) -> np.ndarray:
        out = self.table[g >> np.uint64(HASH_BITS - 20)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, g[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == g[some]
        return out


def _names(r: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Bounds of the sets and a 128-bit name of each."""
    bounds = np.searchsorted(r, np.arange(n + 1))
    data = g.tobytes()
    return bounds, [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def needed(a, b, percent: int):
    """Least intersection of linked sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def map_bits(n: np.ndarray, percent: int) -> np.ndarray:
    """Width of the bitmap of a set of n: a power of two, 2.4 times the greatest symmetric difference of a link or more."""
    want = 2.4 * n * 2 * (100 - percent) / (100 + percent)
    return np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(1, want))).astype(np.int64))


def parity_maps(r: np.ndarray, g: np.ndarray, n: np.ndarray, percent: int) -> list[bytes]:
    """For each set, whether the number of elements at each place is odd. The distance of two maps bounds the symmetric difference from below."""
    bits = map_bits(n, percent)
    out: list[bytes] = [b""] * len(n)
    spot = W.mix(g ^ _SALT)
    for b in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == b)
        number = np.full(len(n), -1)
        number[rows] = np.arange(len(rows))
        mine = number[r] >= 0
        place = number[r[mine]] * b + (spot[mine] & np.uint64(b - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=len(rows) * b).astype(np.uint8) & 1
        for i, x in zip(rows.tolist(), np.packbits(odd.reshape(-1, b), axis=1), strict=True):
            out[i] = x.tobytes()
    return out


def folded(maps: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Width of each map in bytes, and for each width the maps that are as wide or wider, folded to it (numbers of rows, words).

    Two halves of a map, one laid over the other by exclusive or, are the map of half the width.
    """
    width = np.fromiter(map(len, maps), np.int64, len(maps))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows, words = np.zeros(0, np.int64), np.zeros((0, 0), np.uint64)
    for w in sorted(set(width.tolist()), reverse=True):
        while len(rows) and words.shape[1] * 8 > w:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        own = np.flatnonzero(width == w)
        data = np.frombuffer(b"".join(maps[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)
        rows, words = np.concatenate([rows, own]), np.concatenate([words.reshape(len(rows), w // 8), data])
        number = np.full(len(maps), -1)
        number[rows] = np.arange(len(rows))
        out[w] = (number, words)
    return width, out


def _long_lists(docs: DataFrame, k: int, long: int) -> LongLists:
    """Hashes of shingles that about `long` sets or more hold.

    Tasks count their own sets and report what occurs twice at least, so single shingles are not
    shuffled; a shingle's total may fall short of its true count, which only affects the order.
    """

    def run(batches):
        counter, seen = W.Counter(4_000_000), set()
        for b in batches:
            for _, t in W.parts(b.column(1), rows=ROWS):
                r, g = shingle_sets(t, k)
                _, names = _names(r, g, t.n)
                new = np.zeros(t.n, bool)
                if len(seen) > 1 << 18:
                    seen.clear()
                for i, x in enumerate(names):
                    if x[:8] not in seen:
                        seen.add(x[:8])
                        new[i] = True
                if counter.add(g[new[r]]):
                    yield from counter.take(2)
        yield from counter.take(2)

    counts = docs.mapInArrow(W.lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= long)
    return LongLists(counts.orderBy(F.desc("c"), "h").limit(MOST_LONG).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _sketches(docs: DataFrame, id_kind: str, k: int, percent: int, long: LongLists) -> DataFrame:
    """id, name, size, the lists to merge and the parity bitmap of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(long)

    def run(batches):
        long = sent.value
        for b in batches:
            for lo, t in W.parts(b.column(1), rows=ROWS):
                r, g = shingle_sets(t, k, long)
                bounds, names = _names(r, g, t.n)
                n = np.diff(bounds)
                take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                inner = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                lists = g[np.repeat(bounds[:-1], take) + inner]
                maps = parity_maps(r, g, n, percent)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, t.n), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(lists.view(np.int64))), pa.array(maps, pa.binary())],
                    ["id", "name", "n", "lists", "map"],
                )

    return docs.mapInArrow(W.lean(run), f"id {id_kind}, name binary, n long, lists array<long>, map binary")


def block_pairs(sizes: np.ndarray, maps: list[bytes], comps: np.ndarray, groups: np.ndarray, percent: int, at_once: int = 1 << 17):
    """(i, j, distance) arrays of the pairs of one group each that may link and lie in different components.

    groups: bounds of the groups; pairs of all groups are enumerated together, `at_once` at a time.
    """
    width, by_width = folded(maps)
    m = np.diff(groups)
    last = np.repeat(groups[1:], m)
    mates = last - np.arange(len(sizes)) - 1  # members after each in its group
    total = np.concatenate([[0], np.cumsum(mates)])
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once, "right")) - 1)
        n = mates[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        sum_, least_size = sizes[i] + sizes[j], np.minimum(sizes[i], sizes[j])
        least = needed(sum_, 0, percent)
        keep = np.flatnonzero((least_size >= least) & (comps[i] != comps[j]))
        i, j, room = i[keep], j[keep], (sum_ - 2 * least)[keep]
        apart = np.zeros(len(i), np.int64)
        narrow = np.minimum(width[i], width[j])
        for w, (number, words) in by_width.items():
            at = np.flatnonzero(narrow == w)
            apart[at] = np.bitwise_count(words[number[i[at]]] ^ words[number[j[at]]]).sum(axis=1, dtype=np.int64)
        keep = apart <= room
        yield i[keep], j[keep], apart[keep]
        lo = hi


def _propose(members: DataFrame, id_kind: str, percent: int, later: bool) -> DataFrame:
    """(h, a, b), a < b: the pairs that the blocks (h, i, j) propose.

    In the first round a spanning forest of each block, later each member's nearest TRIES partners.
    """

    def groups(batches):
        held = None
        for b in batches:
            table = pa.Table.from_batches([b])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            h, x, y = (table.column(c).to_numpy() for c in ("h", "i", "j"))
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            if len(cuts):  # the last group may go on in the next batch
                yield table.slice(0, cuts[-1]), np.concatenate([[0], cuts])
                held = table.slice(cuts[-1])
            else:
                held = table
        if held is not None and len(held):
            yield held, np.array([0, len(held)])

    def run(batches):
        for g, bounds in groups(batches):
            ids, h = g.column("id").to_numpy(), g.column("h").to_numpy()
            rank = np.unique(ids, return_inverse=True)[1]  # ids may be of any ordered type
            sizes, comps = g.column("n").to_numpy(), g.column("comp").to_numpy()
            maps = g.column("map").to_pylist()
            got = [x for x in block_pairs(sizes, maps, comps, bounds, percent) if len(x[0])]
            if not got:
                continue
            i, j, apart = (np.concatenate(c) for c in zip(*got, strict=True))
            if later:
                refused = g.column("refused").to_pylist()
                fresh = np.array([not (refused[a] and ids[b] in refused[a]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j, apart = i[fresh], j[fresh], apart[fresh]
                chosen = nearest(i, j, apart, TRIES)
            else:
                chosen = forest(rank, bounds, i, j, apart)
            i, j = i[chosen], j[chosen]
            first = rank[i] < rank[j]
            kind = g.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(ids[np.where(first, i, j)], kind), pa.array(ids[np.where(first, j, i)], kind)], ["h", "a", "b"])

    return members.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "id").mapInArrow(W.lean(run), f"h long, a {id_kind}, b {id_kind}")


def nearest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, tries: int) -> np.ndarray:
    """Which pairs are among the `tries` nearest of one of their members."""
    chosen = np.zeros(len(i), bool)
    for one in (i, j):
        order = np.lexsort((apart, one))
        rank = np.arange(len(order)) - np.searchsorted(one[order], one[order])
        chosen[order[rank < tries]] = True
    return chosen


def forest(rank: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Indices of pairs that make a spanning forest of each block, nearest pairs first; ties by the ids' rank."""
    root = list(range(len(rank)))
    picked = []
    for k in np.lexsort((rank[j], rank[i], apart)).tolist():
        a, b = int(i[k]), int(j[k])
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            picked.append(k)
    return np.array(picked, np.int64)


def overlap(x: np.ndarray, y: np.ndarray, x_long: int, y_long: int, percent: int) -> int:
    """Size of the intersection of two sets, or less if it does not reach what a link needs.

    Both have their short lists first and as many long ones last as the numbers say, each part ascending.
    """
    if len(x) > len(y):
        x, y, x_long, y_long = y, x, y_long, x_long
    least = needed(len(x), len(y), percent)
    both = _common(x[: len(x) - x_long], y[: len(y) - y_long])
    if both + min(x_long, y_long) < least:
        return both
    return both + _common(x[len(x) - x_long :], y[len(y) - y_long :])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements of x binary search finds in y; both ascend."""
    if not len(x) or not len(y):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _verify(docs: DataFrame, pairs: DataFrame, id_kind: str, k: int, percent: int, long: LongLists) -> DataFrame:
    """pairs with `linked`: whether merging the short lists and probing the long ones reaches the needed overlap."""
    sent = docs.sparkSession.sparkContext.broadcast(long)

    def sets(batches):
        for b in batches:
            for lo, t in W.parts(b.column(1), rows=ROWS):
                r, g = shingle_sets(t, k, sent.value)
                bounds = np.searchsorted(r, np.arange(t.n + 1)).tolist()
                n_long = np.bincount(r[sent.value.holds(g)], minlength=t.n)
                data = g.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, t.n), pa.array([data[8 * x : 8 * y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array(n_long, pa.int32())], ["id", "shingles", "n_long"])

    def probe(batches):
        for b in batches:
            linked = []
            for x, y, i, j in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                linked.append(len(x) > 0 and len(y) > 0 and overlap(x, y, i, j, percent) >= needed(len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    ids = _scratch.write(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "proposed")
    held = _scratch.by_ids(docs, "id", ids, "left_semi").mapInArrow(W.lean(sets), f"id {id_kind}, shingles binary, n_long int").dropDuplicates(["id", "shingles"])
    held = _scratch.write(held, "sets")
    joined = pairs.join(held.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("n_long").alias("i")), "a").join(held.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("n_long").alias("j")), "b")
    out = _scratch.write(joined.select("a", "b", "x", "y", "i", "j").mapInArrow(W.lean(probe), f"a {id_kind}, b {id_kind}, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")
    _scratch.drop(held)
    _scratch.drop(ids)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of edges (a, b): the smallest id it can reach, by alternating large and small stars."""
    both = F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")
    now, last = _scratch.write(edges.select(*both).where("u > v").distinct(), "stars"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or not state[0]:
            break
        last = state
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        sym = now.union(now.select("u", "v")).toDF("n", "u")  # u sees n
        least = sym.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("n > u").select(F.col("n").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = _scratch.write(small.where("u > v").select("v", "u").distinct(), "stars")
        _scratch.drop(now)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())


def _postings(posting: DataFrame, block: int) -> DataFrame:
    """(h, id, m) of the lists with m > 1 members; of lists with the same members, one.

    The members of a list of more than a block never meet in one task: such lists are few, so while
    their number is within `MOST_LONG` they are sent to the postings.
    """
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    size = posting.groupBy("h").agg(F.count("*").alias("m"), *same).where("m > 1")
    size = _scratch.write(size.groupBy("m", "s0", "s1").agg(F.min("h").alias("h")).select("h", "m"), "lists")
    hot = size.where(F.col("m") > block)
    if hot.count() > MOST_LONG:
        return _scratch.write(posting.join(size.hint("merge"), "h").select("h", "id", "m").distinct(), "postings")
    few = posting.join(F.broadcast(hot.select("h")), "h", "left_anti").join(size.where(F.col("m") <= block).hint("merge"), "h")
    return _scratch.write(few.unionByName(posting.join(F.broadcast(hot), "h")).select("h", "id", "m").distinct(), "postings")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, long: int = LONG, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One row for each row of docs: its id, n_shingles and component_id, the smallest id that links reach."""
    since = _scratch.mark()
    id_kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = _long_lists(docs, k, long)
    every = _scratch.write(_sketches(docs, id_kind, k, percent, lists), "sketches")
    # One member for each set; its id is the smallest of its copies.
    member = _scratch.write(every.where("n > 0 and id is not null").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("lists").alias("lists"), F.first("map").alias("map")), "members")
    shared = _postings(member.select(F.explode("lists").alias("h"), "id"), block)
    facts = member.select("id", "n", "map")
    comps, refused, links, active = None, None, None, None
    while True:
        if active is None:
            # First round: blocks of each list, and pivots in all of them.
            n_blocks = F.ceil(F.col("m") / block).cast("int")
            own = F.pmod(F.xxhash64("id"), n_blocks.cast("long")).cast("int")
            pivot = (n_blocks > 1) & (F.pmod(F.xxhash64("h", "id"), F.col("m")) < pivots)
            dealt = shared.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array(own)))).select("h", "id", "i", F.lit(0).alias("j"))
            dealt = dealt.join(facts, "id").withColumn("comp", F.col("id")).withColumn("refused", F.lit(None).cast(f"array<{id_kind}>"))
        else:
            # Later rounds: the members of lists that are not settled against those outside the list's largest component.
            held = _scratch.by_ids(shared, "h", active, "left_semi").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            part = held.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("most"))
            part = _scratch.write(part, "parts", small=True)  # a row for each list, which goes to its members while they are few
            left = held.join(F.broadcast(part) if part.count() <= MOST_LONG // 2 else part.hint("merge"), "h").where(F.col("most") < F.col("m"))
            n_blocks, n_out = F.ceil(F.col("m") / block).cast("int"), F.ceil((F.col("m") - F.col("most")) / block).cast("int")
            own = F.pmod(F.xxhash64("id"), n_blocks.cast("long")).cast("int")
            own_out = F.pmod(F.xxhash64("id", F.lit(1)), n_out.cast("long")).cast("int")
            rows = F.transform(F.sequence(F.lit(0), n_out - 1), lambda j: F.struct(own.alias("i"), j.alias("j")))
            columns = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.struct(i.alias("i"), own_out.alias("j")))
            at = F.explode(F.array_distinct(F.when(F.col("comp") == F.col("top"), rows).otherwise(F.concat(rows, columns))))
            dealt = left.select("h", "id", "comp", at.alias("at")).select("h", "id", "comp", "at.i", "at.j").join(facts, "id").join(refused, "id", "left")
        proposed = _scratch.write(_propose(dealt.select("h", "i", "j", "id", "n", "map", "comp", "refused"), id_kind, percent, active is not None), "pairs")
        pairs = proposed.select("a", "b").distinct()
        if proposed.isEmpty():
            break
        verified = _verify(docs, pairs, id_kind, k, percent, lists)
        links = verified if links is None else links.union(verified)
        # Unsettled: in the first round lists with a refused pair or of several blocks, later all that proposed.
        if active is None:
            wrong = proposed.join(verified.where("not linked"), ["a", "b"], "left_semi").select("h")
            active = wrong.union(shared.where(F.col("m") > block).select("h"))
        else:
            active = proposed.select("h")
        active = _scratch.write(active.distinct(), "active")
        if active.isEmpty():
            comps = _scratch.write(components(links.where("linked")), "components")
            break
        no = links.where("not linked")
        refused = no.select(F.col("a").alias("id"), F.col("b").alias("x")).union(no.select("b", "a")).groupBy("id").agg(F.collect_set("x").alias("refused"))
        comps = _scratch.write(components(links.where("linked")), "components")
    _scratch.release(since, every, member, *([comps] if comps is not None else []))
    out = every.join(member.select("name", F.col("id").alias("node")), "name", "left")
    if comps is not None:
        out = out.join(comps.withColumnRenamed("id", "node"), "node", "left")
        label = F.coalesce("comp", "node", "id")
    else:
        label = F.coalesce("node", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), label).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each component: that with the smallest id."""
    since = _scratch.mark()
    found = join(docs, id_col, text_col, k, percent)
    gone = _scratch.write(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "removed")
    _scratch.release(since, gone)
    return _scratch.by_ids(docs, id_col, gone, "left_anti").select(docs.columns)
