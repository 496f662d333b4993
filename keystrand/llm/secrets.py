"""Secret scan over a trigram inverted index.

Each rule is a regular expression.  `trigram_query` derives from its syntax
tree a Boolean query (a list, all of whose groups must hold; a group is a list
of alternatives; an alternative is a set of trigrams that all occur).  For each
block of texts the postings of the trigrams that the rules ask for are built,
the queries are answered by intersecting and uniting postings, and the
candidate texts are verified with the expression itself.  A rule without a
mandatory trigram reads all texts of the block.

Postings are case-folded, which only ever adds candidates; trigrams hold ASCII
characters only, others in a rule's literals ask for nothing.

Edge cases: null is an empty text; repeated rows are scanned row by row;
overlapping spans of different kinds are all reported, those of one start in the
order of the rules; a text of any length is scanned whole; columns other than the two
named are not looked at; an empty table gives an empty table.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from re import _parser as _syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

# Kind, expression, flags, group whose length counts, least length. The first three are the base rules.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0, 0),
    ("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    ("login", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 0, 0),
)
BASE = ("assign", "access", "hex")

Query = list  # of groups; a group is a list of frozensets of trigrams
_MOST = 64  # strings that an exact set may hold


def _exact(node) -> set[str] | None:
    """All strings that a node of the syntax tree matches, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg)}
    if op == "SUBPATTERN":
        return _exact_all(arg[-1])
    if op == "BRANCH":
        got = [_exact_all(x) for x in arg[1]]
        return None if None in got else set().union(*got)
    if op == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < 10:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        if high > 8 or (one := _exact_all(body)) is None:
            return None
        out, now = set(), {""}
        for k in range(int(high) + 1):
            if k >= low:
                out |= now
            now = {a + b for a in now for b in one}
            if len(now) > _MOST:
                return None
        return out
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        if (one := _exact(node)) is None:
            return None
        out = {a + b for a in out for b in one}
        if len(out) > _MOST:
            return None
    return out


def _needs(strings: set[str]) -> Query:
    """The group that says that one of the strings occurs; empty if one of them has no trigram of ASCII characters."""
    folded = {x.lower() for x in strings}
    some = {frozenset(x[i : i + 3] for i in range(len(x) - 2) if x[i : i + 3].isascii()) for x in folded}
    return [sorted(some, key=sorted)] if frozenset() not in some else []


def _query(nodes) -> Query:
    out: Query = []
    run = {""}
    for node in nodes:
        one = _exact(node)
        if one is not None and len(run) * len(one) <= 4 * _MOST:
            run = {a + b for a in run for b in one}
            continue
        out += _needs(run)
        run = one if one is not None else {""}
        op, arg = str(node[0]), node[1]
        if op == "SUBPATTERN":
            out += _query(arg[-1])
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out += _query(arg[2])
    return out + _needs(run)


def trigram_query(pattern: str) -> Query:
    """Groups of alternatives of trigrams, case-folded; empty: no mandatory trigram."""
    return _query(_syntax.parse(pattern))


def run_of(pattern: str, flags: int, group: int, least: int) -> re.Pattern | None:
    """For a rule that asks for `least` characters of one class of ASCII characters, in either case if it ignores case: such a run, in bytes."""
    if group or not least or not re.fullmatch(r"\[[A-Za-z0-9_-]+\]\+", pattern):
        return None
    return re.compile(pattern[:-1].encode() + b"{%d,}" % least, flags & re.I)


def _code(t: str) -> int:
    a, b, c = t.encode("ascii")
    return a << 16 | b << 8 | c


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(p, f), g, least, trigram_query(p), run_of(p, f, g, least)) for kind, p, f, g, least in rules]
        self.order = {r[0]: i for i, r in enumerate(self.rules)}
        codes = sorted({_code(t) for r in self.rules for group in r[4] for alt in group for t in alt})
        self.codes = np.array(codes, np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def postings(self, t: W.Text) -> dict[int, np.ndarray]:
        """Rows that hold each wanted trigram, ascending."""
        b = W.LOWER[t.raw].astype(np.int32)
        if len(b) < 3:
            return {}
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(t.off, at, "right") - 1
        inside = at + 3 <= t.off[row + 1]
        pairs = np.unique(np.searchsorted(self.codes, code[at[inside]]).astype(np.int64) * t.n + row[inside])
        which, row = pairs // t.n, pairs % t.n
        cuts = np.searchsorted(which, np.arange(len(self.codes) + 1))
        return {int(c): row[cuts[i] : cuts[i + 1]] for i, c in enumerate(self.codes)}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        none = np.zeros(0, np.int64)
        rows = np.arange(n)
        for group in query:
            union = none
            for alternative in group:
                both = None
                for t in alternative:
                    list_ = postings.get(_code(t), none)
                    both = list_ if both is None else np.intersect1d(both, list_, assume_unique=True)
                union = np.union1d(union, both)
            rows = np.intersect1d(rows, union, assume_unique=True)
        return rows

    def scan(self, t: W.Text) -> list[list[tuple[int, int, str, int]]]:
        """For each row, (start, kind's place, kind, end) in order; offsets in code points."""
        postings = self.postings(t)
        raw = t.raw.tobytes()
        texts: dict[int, str] = {}
        found: list[list] = [[] for _ in range(t.n)]
        for kind, expression, group, least, query, run in self.rules:
            if query:
                rows = self.candidates(query, postings, t.n)
            elif run is not None:
                # A full scan of all texts at once, in bytes. A run may go over the end of a text.
                ends = np.searchsorted(t.off, [x for m in run.finditer(raw) for x in (m.start(), m.end() - 1)], "right") - 1
                rows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ends.reshape(-1, 2)] or [ends]))
            else:
                rows = np.arange(t.n)
            for d in map(int, rows):
                if d not in texts:
                    texts[d] = raw[t.off[d] : t.off[d + 1]].decode()
                for m in expression.finditer(texts[d]):
                    if len(m[group]) >= least:
                        found[d].append((m.start(), self.order[kind], kind, m.end()))
        for x in found:
            x.sort()
        return found


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row for each row of docs: counts, a digest of the base spans and all spans."""

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            for lo, t in W.parts(b.column(1)):
                found = scanner.scan(t)
                base = [[x for x in f if x[2] in BASE] if f else f for f in found]
                counts = [[sum(x[2] == k for x in f) for f in base] for k in BASE]
                digest = [hashlib.sha256(_joined(f).encode()).hexdigest() for f in base]
                arrays = [b.column(0).slice(lo, t.n), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_joined(f) for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, *(x.split()[0] for x in COLUMNS.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(W.lean(run), f"`{id_col}` {kind}, {COLUMNS}")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules=RULES) -> DataFrame:
    """docs with every found span replaced; touching or overlapping spans get one mask."""
    k = docs.columns.index(text_col)

    def run(batches):
        scanner = Scanner(rules)
        for b in batches:
            for lo, t in W.parts(b.column(k)):
                part = b.slice(lo, t.n)
                texts = part.column(k).to_pylist()
                for d, found in enumerate(scanner.scan(t)):
                    out, at = [], 0
                    for start, _, _, end in found:
                        if start > at or not out:
                            out += [texts[d][at:start], mask]
                        at = max(at, end)
                    if found:
                        texts[d] = "".join(out) + texts[d][at:]
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    return docs.mapInArrow(W.lean(run), docs.schema)
