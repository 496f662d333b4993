"""Token counts by unigram scores over a trie of pre-tokens.

A text's pre-tokens are its words between ASCII white space, each with the
vocabulary's word mark in front.  The best segmentation of a pre-token under a
unigram model is found by dynamic programming over its prefixes.  Distinct
pre-tokens are inserted in a trie, and the forward score of each prefix (its best
score, and the tokens of it) is computed once, at its node: all nodes of a level
together, for each length that the last piece can have.  The counts at a
pre-token's last node are stored and looked up for every occurrence.

Scores: the public vocabulary file lists its pieces by rank and holds no
probabilities, so they are fitted to the corpus.  Starting from Zipf's law by rank
(the piece of rank r weighs 1 / (r + 1)), `ROUNDS` times all distinct pre-tokens are
segmented, a piece's occurrences in the best segmentations are counted, c for the
piece and N in all, and its score becomes log((c + 0.5) / (N + 0.5 V)).  The
vocabulary itself is taken as it is.  A character that no piece covers costs its
UTF-8 bytes, each as one token of the lowest score less 10.  Among segmentations of
equal score the one with fewer tokens counts, then the one whose last piece is
shorter.

The pre-tokens and their frequencies are a distributed table; what the driver gathers
and sends is one number for each piece of the vocabulary.

Edge cases: a null or empty text has no tokens; repeated rows are counted row
by row; a pre-token of more than `LEVELS` characters is scored by itself, with the
same result; columns other than the two named are not looked at; an empty table gives
an empty table.  Memory is bounded by a block's distinct pre-tokens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import _words as W

MARK = "▁"
ROUNDS = 2
LEVELS = 64  # characters of the pre-tokens that go into the trie
BYTE_PENALTY = 10.0
_MEMO = 400_000  # pre-tokens whose counts a task remembers
_BASE = 0x9E3779B97F4A7C15
_SLOTS = 20  # bits of the table in front of the pieces' hashes

COLUMNS = "n_pretokens long, n_tokens long, n_bytes_fallback long"


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file, by rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p for p in pieces if set(p) != {MARK} or p == MARK]


def by_rank(n: int) -> np.ndarray:
    """Scores by Zipf's law."""
    weight = 1 / np.arange(1, n + 1)
    return np.log(weight / weight.sum())


def _code_points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)


class Trie:
    """Forward scores of pre-tokens, one for each node."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        self.longest = max(map(len, pieces), default=1)
        self.byte = float(scores.min()) - BYTE_PENALTY if len(scores) else -BYTE_PENALTY
        self.scores, self.pieces = scores, pieces
        self.steps = 0  # nodes scored, for tests
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.maybe = np.zeros(1 << _SLOTS, bool)
        self.maybe[self._slot(self.hashes)] = True
        power = [1]
        for _ in range(self.longest):
            power.append(power[-1] * _BASE % 2**64)
        self.power = np.array(power, np.uint64)
        self.known = {p: i for i, p in enumerate(pieces)}

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * _BASE + ord(c) + 1) % 2**64
        return out

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (W.mix(h) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of pieces, and of which."""
        some = np.flatnonzero(self.maybe[self._slot(h)])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        held = self.hashes[at] == h[some]
        return some[held], self.order[at[held]]

    def build(self, words: list[str]) -> np.ndarray:
        """Inserts words of at most LEVELS characters; the last node of each.

        Nodes are numbered level by level, 0 being the root; `best`, `size`, `spare` are the score, tokens and
        byte tokens of a node's prefix, `back` and `last` the node before its last token and that token's piece.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        by = np.argsort(-size, kind="stable")
        points = _code_points(words)
        start = (np.cumsum(size) - size)[by]
        live = np.searchsorted(-size[by], -np.arange(1, int(size.max(initial=0)) + 1), "right")  # words that reach each level
        parts = [[np.zeros(1, t)] for t in (np.int64, np.uint64, float, np.int64, np.int64, np.int64, np.int64)]
        self.parent, self.h, self.best, self.size, self.spare, self.back, self.last = (p[0] for p in parts)
        node, done = np.zeros(len(words), np.int64), 1
        for level, n in enumerate(live.tolist(), 1):
            char = points[start[:n] + level - 1]
            key, which = np.unique(node[:n] << 21 | char.astype(np.int64), return_inverse=True)
            node[:n] = done + which
            parent, char = key >> 21, (key & ((1 << 21) - 1)).astype(np.uint64)
            h = self.h[parent] * np.uint64(_BASE) + char + np.uint64(1)
            # A character by itself falls back to its bytes.
            wide = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF).astype(np.int64)
            best, tokens, spare = self.best[parent] + wide * self.byte, self.size[parent] + wide, self.spare[parent] + wide
            back, last = parent.copy(), np.full(len(key), -1)
            before = parent
            for k in range(1, min(level, self.longest) + 1):
                at, piece = self._find(h - self.h[before] * self.power[k])
                from_ = before[at]
                score, count = self.best[from_] + self.scores[piece], self.size[from_] + 1
                up = (score > best[at]) | (score == best[at]) & (count < tokens[at])
                at, piece, from_ = at[up], piece[up], from_[up]
                best[at], tokens[at], spare[at], back[at], last[at] = score[up], count[up], self.spare[from_], from_, piece
                before = self.parent[before]
            done += len(key)
            self.parent, self.h, self.best, self.size, self.spare, self.back, self.last = (np.concatenate(x) for x in zip((self.parent, self.h, self.best, self.size, self.spare, self.back, self.last), (parent, h, best, tokens, spare, back, last), strict=True))
        self.steps += done - 1
        out = np.empty(len(words), np.int64)
        out[by] = node
        return out

    def alone(self, word: str) -> tuple[int, int, list[int]]:
        """Tokens, byte tokens and pieces (-1: a character in bytes) of one word of any length."""
        best, size, spare, back = [0.0], [0], [0], [(0, -1)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            top, tokens, bytes_, way = best[end - 1] + n * self.byte, size[end - 1] + n, spare[end - 1] + n, (end - 1, -1)
            for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
                piece = self.known.get(word[begin:end])
                if piece is not None:
                    score = best[begin] + float(self.scores[piece])
                    if score > top or score == top and size[begin] + 1 < tokens:
                        top, tokens, bytes_, way = score, size[begin] + 1, spare[begin], (begin, piece)
            best.append(top)
            size.append(tokens)
            spare.append(bytes_)
            back.append(way)
        pieces, at = [], len(word)
        while at:
            at, piece = back[at]
            pieces.append(piece)
        return size[-1], spare[-1], pieces

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens and byte tokens of each word."""
        out = np.zeros((len(words), 2), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LEVELS]
        end = self.build([words[i] for i in short])
        out[short, 0], out[short, 1] = self.size[end], self.spare[end]
        for i, w in enumerate(words):
            if len(w) > LEVELS:
                out[i] = self.alone(w)[:2]
        return out

    def uses(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Occurrences of each piece in the best segmentations of words that occur so many times."""
        out = np.zeros(len(self.pieces))
        short = [i for i, w in enumerate(words) if len(w) <= LEVELS]
        at, n = self.build([words[i] for i in short]), times[short].astype(float)
        while len(at):
            piece = self.last[at]
            held = piece >= 0
            out += np.bincount(piece[held], weights=n[held], minlength=len(out))
            at = self.back[at]
            at, n = at[at > 0], n[at > 0]
        for i, w in enumerate(words):
            if len(w) > LEVELS:
                pieces = np.array(self.alone(w)[2])
                out += np.bincount(pieces[pieces >= 0], minlength=len(out)) * float(times[i])
        return out


def _distinct(t: W.Text) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Row and number of each word; distinct words and how often each occurs."""
    row, start, stop = t.words(W.NOT_SPACE)
    _, first, which, count = np.unique(t.hashes(start, stop), return_index=True, return_inverse=True, return_counts=True)
    raw = t.raw.tobytes()
    return row, which, [raw[x:y] for x, y in zip(start[first].tolist(), stop[first].tolist(), strict=True)], count


def pretokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c): distinct words of all texts and how often each occurs; summed up in the tasks first."""

    def run(batches):
        held: dict[bytes, int] = {}

        def take():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for b in batches:
            for _, t in W.parts(b.column(0)):
                _, _, words, count = _distinct(t)
                for w, c in zip(words, count.tolist(), strict=True):
                    held[w] = held.get(w, 0) + c
                if len(held) > _MEMO:
                    yield take()
                    held.clear()
        yield take()

    return docs.select(text_col).mapInArrow(W.lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, pieces: list[str], text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Scores of the pieces, fitted to all texts."""
    scores = by_rank(len(pieces))
    words = _scratch.write(pretokens(docs, text_col), "pretokens")
    spark = docs.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, scores))

        def run(batches, sent=sent):
            trie = Trie(*sent.value)
            total = np.zeros(len(trie.pieces))
            for b in batches:
                for lo in range(0, b.num_rows, 1 << 16):
                    part = b.slice(lo, 1 << 16)
                    total += trie.uses([MARK + w.decode() for w in part.column(0).to_pylist()], part.column(1).to_numpy())
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["piece", "c"])

        uses = words.mapInArrow(W.lean(run), "piece int, c double").groupBy("piece").agg(F.sum("c").alias("c")).toPandas()
        sent.unpersist(blocking=False)
        c = np.zeros(len(pieces))
        c[uses["piece"].to_numpy(np.int64)] = uses["c"].to_numpy(float)
        scores = np.log((c + 0.5) / (c.sum() + 0.5 * max(1, len(pieces))))
    _scratch.drop(words)
    return scores


def count(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs: id, pre-tokens, tokens and those of them that are single bytes."""
    pieces = vocabulary(model)
    scores = fit(docs, pieces, text_col, rounds)
    _scratch.tidy(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, scores))

    def run(batches):
        trie, memo = Trie(*sent.value), {}
        for b in batches:
            for lo, t in W.parts(b.column(1)):
                row, which, distinct, _ = _distinct(t)
                if len(memo) + len(distinct) > _MEMO:
                    memo.clear()
                new = [w for w in distinct if w not in memo]
                memo.update(zip(new, map(tuple, trie.counts([MARK + w.decode() for w in new]).tolist()), strict=True))
                per = np.array([memo[w] for w in distinct], np.int64).reshape(-1, 2)
                n = [np.bincount(row, weights=per[which, k] if len(row) else None, minlength=t.n).astype(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, t.n), pa.array(np.bincount(row, minlength=t.n)), *map(pa.array, n)], [id_col, *(x.split()[0] for x in COLUMNS.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(W.lean(run), f"`{id_col}` {kind}, {COLUMNS}")
