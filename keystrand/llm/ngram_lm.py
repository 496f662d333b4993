"""Language-model scores by a weighted backoff automaton.

Every word, pair and triple of the training tokens is counted exactly (the text
start and end are words in pairs and triples), and every one of them is an arc:
there is no least count, and no bound on their number.  The automaton's states are
the contexts seen in training (a pair, a word, the text start, or nothing).  With
hierarchical Dirichlet smoothing

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1)), one share standing for all unknown words
    p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K), h' being h without its first word

an arc carries log10 p(w | h), and a state's failure arc, which leads to h',
carries log10 K / (c(h) + K).  The probabilities of a state add up to one.  K is
`PRIOR` for contexts of one and of two words.

The model is never in one place.  Texts are cut once into blocks of about
`BLOCK_TOKENS` tokens, a written table.  Each block asks for the totals of its own
n-grams: it deals its sorted distinct keys and their counts out to buckets of the
key space, a bucket sums up what all blocks say of a key, and answers each block
in the order of its keys.  Pairs and words are asked for first, then those triples
whose two pairs occur twice or more in all texts (the count of any other follows
from its own text: it is 1 there if the text is for training, else 0).  With the
answers a block builds the part of the automaton that its texts can reach, and
traverses them from left to right: the state of a step is the pair that the step
before has taken, if it is one of the model, else its word.

What is shuffled grows with the tokens; a key is held once for each block it is in,
so a frequent one makes no task larger.  Memory of a task is some 200 bytes for
each token of a block; a single longer text is a block of its own.

Words and n-grams are identified by 64-bit hashes.

Edge cases: a null text is empty and consists of its end token; an id is taken as
text for its fold, null as "None"; repeated rows are scored row by row (and counted
in training row by row); without training rows all counts are 0; a text of any
length is scored whole; columns other than the two named are not looked at; an
empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _scratch
from . import _words as W

PRIOR = (64.0, 16.0)  # for contexts of one and of two words
BLOCK_TOKENS = 1 << 19
BUCKET_KEYS = 1 << 20  # keys of a bucket, counted once for each block they are in
FOLDS, HELD_OUT = 5, 1
END = np.uint64(0x9E3779B97F4A7C15)  # stands for the hash of the end token
START = np.uint64(0xC2B2AE3D27D4EB4F)  # and of the text start as a context
_A, _B = W.GRAM[14], W.GRAM[15]

COLUMNS = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ANSWERS = "block long, ord int, bucket int, answer binary, kinds long"


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def _tokens(t: W.Text) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each token; the end token after each text."""
    row, start, stop = t.lower().words(W.NOT_SPACE)
    n = np.bincount(row, minlength=t.n)
    out = np.full(len(row) + t.n, END, np.uint64)
    out[np.arange(len(row)) + row] = t.hashes(start, stop)
    return np.repeat(np.arange(t.n), n + 1), out


def key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of a pair (of the hashes of a context and a word), or of a triple (of those of its two pairs)."""
    return W.mix(x * _A + y * _B)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def pack(x: np.ndarray) -> bytes:
    """Counts, a byte each; those of 255 and more follow in eight bytes."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


_LOW = (1 << 48) - 1


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as six bytes of each one's distance to the one before; larger distances follow in eight bytes."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.minimum(step, np.uint64(_LOW)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + step[step >= _LOW].astype("<u8").tobytes()


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    step = np.zeros((n, 8), np.uint8)
    step[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(n, 6)
    step = step.view("<u8").ravel()
    step[step == _LOW] = np.frombuffer(data[6 * n :], "<u8")
    return np.cumsum(step, dtype=np.uint64)


def pack_words(word: np.ndarray) -> bytes:
    """Small numbers, compressed byte by byte of their places."""
    import zstandard

    planes = np.ascontiguousarray(word.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_words(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Block:
    """The tokens of some texts: `vocab` are the distinct hashes, `word` the place of each token's in them."""

    def __init__(self, ids: list, sizes: np.ndarray, vocab: np.ndarray, word: np.ndarray):
        self.ids, self.n, self.vocab, self.word = ids, len(ids), vocab, word
        self.held = held_out(ids)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.train = ~self.held[self.row]
        self.first = np.ones(len(word), bool)  # tokens that begin a text
        self.first[1:] = self.row[1:] != self.row[:-1]
        h = vocab[word]
        context = np.empty(len(h), np.uint64)
        context[1:] = h[:-1]
        context[self.first] = START
        self.pair = key(context, h)

    def counts(self) -> np.ndarray:
        """Occurrences of each word."""
        return np.bincount(self.word, minlength=len(self.vocab))

    def triples(self, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens that end a triple both of whose pairs are marked, and its key."""
        at = np.flatnonzero(twice[1:] & twice[:-1] & ~self.first[1:]) + 1
        return at, key(self.pair[at - 1], self.pair[at])


class Automaton:
    """The states, arcs and failure arcs that a block's texts can reach.

    States are the empty context, one for each word of the block and for the text start (the last of
    `context`, which holds how often each was seen in training), and one for each pair.
    """

    def __init__(self, total: int, kinds: int, starts: int, words: np.ndarray, prior: tuple = PRIOR):
        """words: training counts of the block's words."""
        self.scale, self.prior = total + 0.5 * (kinds + 1), prior
        self.known = words > 0
        self.unigram = np.log10((words + 0.5) / self.scale)
        self.context = np.concatenate([words, [starts]])  # of contexts of one word, the text start last

    def step(self, low: np.ndarray, count: np.ndarray, context: np.ndarray, order: int) -> np.ndarray:
        """log10 weight of the way from a state with this context count: its arc if there is one, else the failure arc and `low`, the weight from the next state."""
        k = self.prior[order]
        failure = np.log10(k / (context + k))
        arc = np.log10((count + k * 10.0**low) / (context + k))
        return np.where(count > 0, arc, failure + low)

    def traverse(self, b: Block, pairs: np.ndarray, at: np.ndarray, triples: np.ndarray) -> np.ndarray:
        """Weight of each step; pairs: training counts at all tokens; triples: those at the tokens `at`, whose state is a pair."""
        out = self.unigram[b.word]
        word = np.empty(len(b.word), np.int64)  # the state of one word: the token before
        word[1:] = b.word[:-1]
        word[b.first] = len(self.context) - 1
        out = self.step(out, pairs, self.context[word], 0)
        out[at] = self.step(out[at], triples, pairs[at - 1], 1)
        return out


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Texts as blocks of tokens, a row for each; docs: (id, text)."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        held, size = [], 0

        def take():
            ids = pa.concat_arrays([x[0] for x in held])
            sizes, h = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            vocab, count = distinct(h)
            place = np.empty(len(vocab), np.int64)  # frequent words get small numbers
            place[np.argsort(-count, kind="stable")] = np.arange(len(vocab))
            words = place[np.searchsorted(vocab, h)]
            vocab = vocab[np.argsort(place)]
            train = ~held_out(ids.to_pylist())
            data = b"".join([np.array([len(sizes), len(vocab)], "<i8").tobytes(), sizes.astype("<i8").tobytes(), vocab.astype("<u8").tobytes(), pack_words(words)])
            block = int.from_bytes(os.urandom(8), "big") >> 1
            columns = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary()), *(pa.array([int(x)]) for x in (sizes[train].sum(), train.sum(), len(h)))]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "data", "train_tokens", "train_docs", "n"])

        for b in batches:
            for lo, t in W.parts(b.column(1)):
                row, h = _tokens(t)
                held.append((b.column(0).slice(lo, t.n), np.bincount(row, minlength=t.n), h))
                size += len(h)
                if size >= block_tokens:
                    yield take()
                    held, size = [], 0
        if held:
            yield take()

    return docs.mapInArrow(W.lean(run), f"block long, ids array<{kind}>, data binary, train_tokens long, train_docs long, n long")


def _block(r: dict) -> Block:
    data = r["data"]
    n, m = np.frombuffer(data, "<i8", 2).tolist()
    return Block(r["ids"], np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "<u8", m, 16 + 8 * n), unpack_words(data[16 + 8 * (n + m) :]))


def _rows(batches, *names: str):
    for b in batches:
        columns = [b.column(b.schema.get_field_index(n)) for n in names]
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}


def _groups(rows, *names: str):
    """Runs of rows that agree in the named columns."""
    held: list[dict] = []
    for r in rows:
        if held and any(held[0][n] != r[n] for n in names):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


_ASKED = "block long, ord int, bucket int, n int, keys binary, every binary, held binary"


def _ask(block: int, order: int, keys: np.ndarray, every: np.ndarray, held: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of what a block asks for, one for each bucket that has keys of it; keys ascend, and so do the buckets."""
    edges = np.array([-(-(k << 32) // buckets) << 32 for k in range(1, buckets)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    some = np.flatnonzero(np.diff(cut))
    slices = [slice(*x) for x in zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True)]
    data = [[pack_keys(keys[s]) for s in slices], [pack(every[s]) for s in slices], [pack(held[s]) for s in slices]]
    n = len(some)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, order), pa.int32()), pa.array(some, pa.int32()), pa.array(np.diff(cut)[some], pa.int32()), *(pa.array(x, pa.binary()) for x in data)], [c.split()[0] for c in _ASKED.split(", ")])


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their occurrences and those outside of training."""
    found, every = distinct(keys)
    held = np.bincount(np.searchsorted(found, keys[~train]), minlength=len(found))
    return found, every, held


def _sum_up(batches):
    """The answers of each bucket: 2 c + (1 if it occurs twice or more in all texts) for each key of a block, in the order of its keys; c: occurrences in training."""
    names = [c.split()[0] for c in _ANSWERS.split(", ")]
    for rows in _groups(_rows(batches, "block", "ord", "bucket", "n", "keys", "every", "held"), "ord", "bucket"):
        size = [r["n"] for r in rows]
        keys = np.concatenate([unpack_keys(r["keys"], n) for r, n in zip(rows, size, strict=True)])
        every, held = (np.concatenate([unpack(r[c], n) for r, n in zip(rows, size, strict=True)]) for c in ("every", "held"))
        by = np.argsort(keys)
        keys = keys[by]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        every, held = np.add.reduceat(every[by], new), np.add.reduceat(held[by], new)
        train = every - held
        answer = np.empty(len(keys), np.int64)
        answer[by] = np.repeat(2 * train + (every > 1), np.diff(np.concatenate([new, [len(keys)]])))
        cut = np.cumsum([0, *size]).tolist()
        kinds = np.zeros(len(rows), np.int64)
        kinds[0] = (train > 0).sum()
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["block"] for r in rows]), pa.array([rows[0]["ord"]] * n, pa.int32()), pa.array([rows[0]["bucket"]] * n, pa.int32()), pa.array([pack(answer[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array(kinds)], names
        )


def _answers(asked: DataFrame) -> DataFrame:
    dealt = asked.repartition("ord", "bucket").sortWithinPartitions("ord", "bucket")
    return _scratch.write(dealt.mapInArrow(W.lean(_sum_up), _ANSWERS), "answers", small=True)


def _met(table: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each block, then the answers to it, by order and bucket."""
    out = table.select("block", F.lit(0).alias("ord"), F.lit(0).alias("bucket"), "ids", "data")
    for a in answers:
        out = out.unionAll(a.select("block", "ord", "bucket", F.lit(None).cast(table.schema["ids"].dataType).alias("ids"), F.col("answer").alias("data")))
    return out.repartition("block").sortWithinPartitions("block", "ord", "bucket")


def _answered(batches):
    """(block, its tokens, its answers by order) of each block."""
    for rows in _groups(_rows(batches, "block", "ord", "ids", "data"), "block"):
        parts: dict[int, list[bytes]] = {}
        for r in rows[1:]:
            parts.setdefault(r["ord"], []).append(r["data"])
        yield rows[0]["block"], _block(rows[0]), parts


def _values(parts: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """Answers of all buckets; cuts: how many keys each bucket that has any was asked for."""
    return np.concatenate([unpack(p, n) for p, n in zip(parts, cuts.tolist(), strict=True)] or [np.zeros(0, np.int64)])


def _sizes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys in each bucket that has any."""
    which = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return distinct(which)[1]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: tuple = PRIOR, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row for each row of docs, scored by a model of those that are not held out."""
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    table = _scratch.write(blocks(docs.select(id_col, text_col), block_tokens), "blocks", **{"parquet.block.size": 16 << 20})
    total, starts, tokens = (int(x or 0) for x in table.agg(F.sum("train_tokens"), F.sum("train_docs"), F.sum("n")).first())
    buckets = max(32, -(-tokens // bucket_keys))

    def ask(batches):
        for r in _rows(batches, "block", "ids", "data"):
            block, b = r["block"], _block(r)
            every, by = b.counts(), np.argsort(b.vocab)
            yield _ask(block, 1, b.vocab[by], every[by], np.bincount(b.word[~b.train], minlength=len(every))[by], buckets)
            yield _ask(block, 2, *_counted(b.pair, b.train), buckets)

    first = _answers(table.mapInArrow(W.lean(ask), _ASKED))
    _scratch.tidy(docs.sparkSession)
    kinds = int(first.where("ord = 1").agg(F.sum("kinds")).first()[0] or 0)

    def pairs(b, parts):
        """Training counts of the pairs at all tokens, and whether they occur twice or more at all."""
        keys, _ = distinct(b.pair)
        value = _values(parts[2], _sizes(keys, buckets))[np.searchsorted(keys, b.pair)]
        return value >> 1, (value & 1).astype(bool)

    def ask_triples(batches):
        for block, b, parts in _answered(batches):
            at, keys = b.triples(pairs(b, parts)[1])
            yield _ask(block, 3, *_counted(keys, b.train[at]), buckets)

    second = _answers(_met(table, first).mapInArrow(W.lean(ask_triples), _ASKED))
    _scratch.tidy(docs.sparkSession)

    def traverse(batches):
        for _, b, parts in _answered(batches):
            by, count = np.argsort(b.vocab), np.empty(len(b.vocab), np.int64)
            count[by] = _values(parts[1], _sizes(b.vocab, buckets)) >> 1
            a = Automaton(total, kinds, starts, count, prior)
            count, twice = pairs(b, parts)
            at, keys = b.triples(twice)
            found, _ = distinct(keys)
            triple = b.train.astype(np.int64)  # of a triple that is asked for by nobody
            triple[at] = _values(parts.get(3, []), _sizes(found, buckets))[np.searchsorted(found, keys)] >> 1
            at = np.flatnonzero(~b.first[1:] & (count[:-1] > 0)) + 1
            step = a.traverse(b, count, at, triple[at])
            yield b, a, step

    def result(batches):
        for b, a, step in traverse(batches):
            n, known = np.bincount(b.row, minlength=b.n), np.bincount(b.row[a.known[b.word]], minlength=b.n)
            sums = [np.bincount(b.row, weights=x, minlength=b.n).astype(float) for x in (a.unigram[b.word], step)]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, arrow_kind), pa.array(b.held), pa.array(n), pa.array(known), pa.array(np.full(b.n, total)), *map(pa.array, sums)], [id_col, *(c.split()[0] for c in COLUMNS.split(", "))])

    return _met(table, first, second).mapInArrow(W.lean(result), f"`{id_col}` {kind}, {COLUMNS}").hint("rebalance")
