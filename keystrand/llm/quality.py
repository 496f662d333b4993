"""Quality rules: lines first, then the document.

Each line is judged on its own (punctuation, navigation, boilerplate, shouting,
repetition).  Failing lines go; a document that loses more than `max_lost` of
its words goes too.  A document that fails a base rule (fewer than 50 words, or
over half of them in repeated three-word windows) is rejected in any case.

Edge cases: a null text counts as empty; an empty text has no words and is
rejected; repeated rows are judged row by row; ties do not arise; other columns,
whatever their names, are passed through `filter_documents` untouched and never
looked at; an empty table gives an empty table.  No row is shuffled, and a text is
never cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _words as W

# Fixed values of the rules.
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
MAX_LOST = 0.5  # share of words in removed lines
SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?\"'):;]}"
TERMINAL_WIDE = "«»’”“…。！？」』）"  # quotation marks and full stops outside of ASCII
SHORT_LINE = 8  # words; shorter lines without terminal punctuation look like menu entries
BOILERPLATE = (
    b"all rights reserved", b"licensed under", b"privacy policy", b"terms of use", b"terms of service",
    b"cookie policy", b"use of cookies", b"accept cookies", b"sign up for", b"subscribe to our", b"click here",
    b"share on facebook", b"skip to content", b"enable javascript", b"lorem ipsum", b"powered by",
    *(x.encode() for x in (
        "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "cliquez ici", "abonnez-vous",
        "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "hier klicken", "newsletter abonnieren",
        "todos los derechos reservados", "política de privacidad", "términos de uso", "aceptar cookies", "haga clic aquí", "suscríbete",
    )),
)

_SYMBOL = W.byte_set(SYMBOLS)
_END = W.byte_set(TERMINAL)
_WIDE = sorted({x.encode() for x in TERMINAL_WIDE}, key=len)
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_SMALL = np.array([0x61 <= b <= 0x7A for b in range(256)])
_PHRASE = re.compile(b"|".join(map(re.escape, BOILERPLATE)))

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_removed long"
_NAMES = [x.split()[0] for x in COLUMNS.split(", ")]


def _ends(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each of these bytes is a terminal mark."""
    out = _END[raw[last]]
    for mark in _WIDE:
        same = last >= len(mark) - 1
        for k, x in enumerate(reversed(mark)):
            same &= raw[np.maximum(last - k, 0)] == x
        out |= same
    return out


def _judge(t: W.Text, max_lost: float) -> tuple[list[np.ndarray], dict]:
    row, start, stop = t.words(W.NOT_SPACE)
    h = t.hashes(start, stop)
    n_words = np.bincount(row, minlength=t.n)
    is_word = W.NOT_SPACE[t.raw]
    word_chars = t.per_row(is_word & ((t.raw & 0xC0) != 0x80))
    symbol = _SYMBOL[t.raw]
    n_symbols = t.per_row(symbol)

    covered = np.zeros(len(row), bool)
    at, g = W.grams(h, row, 3)
    if len(at):
        _, inverse, count = np.unique(W.mix(g + row[at].astype(np.uint64) * W.GRAM[9]), return_inverse=True, return_counts=True)
        for k in range(3):
            covered[at[count[inverse] > 1] + k] = True
    n_repeat = np.bincount(row[covered], minlength=t.n)

    of, lo, hi = t.lines()
    line = np.searchsorted(lo, start, "right") - 1
    in_line = np.bincount(line, minlength=len(lo))
    filled = in_line > 0
    key = W.mix(t.hashes(lo[filled], hi[filled]) + of[filled].astype(np.uint64) * W.GRAM[9])
    _, first = np.unique(key, return_index=True)
    n_dup = np.bincount(of[filled], minlength=t.n) - np.bincount(of[filled][first], minlength=t.n)

    upper, small = t.between(_UPPER[t.raw], lo, hi), t.between(_SMALL[t.raw], lo, hi)
    last = np.zeros(len(lo), np.int64)
    last[line] = stop - 1  # words come in order: the last one of each line stays
    bad = filled & (t.between(symbol, lo, hi) * 10 > in_line)
    bad |= filled & (upper + small >= 10) & (2 * upper > upper + small)
    if len(t.raw):
        bad |= filled & (in_line <= SHORT_LINE) & ~_ends(t.raw, last)
    bad |= filled & (in_line >= 10) & (2 * np.bincount(line[covered], minlength=len(lo)) > in_line)
    hits = np.array([m.span() for m in _PHRASE.finditer(W.LOWER[t.raw].tobytes())], np.int64).reshape(-1, 2)
    at = np.searchsorted(lo, hits[:, 0], "right") - 1
    bad[at[hits[:, 1] <= hi[at]]] = True  # not across two texts
    lost = np.bincount(of[bad], weights=in_line[bad], minlength=t.n).astype(np.int64)

    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)
    kept = ~failed & (lost <= max_lost * n_words)
    n_lines = np.bincount(of[filled], minlength=t.n)
    gone = np.bincount(of[bad], minlength=t.n)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, n_lines, gone, lost], {"of": of, "lo": lo, "hi": hi, "bad": bad}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """One row for each row of docs: its id, the counts and the verdict."""

    def run(batches):
        for b in batches:
            for lo, t in W.parts(b.column(1)):
                out, _ = _judge(t, max_lost)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, t.n), *map(pa.array, out)], [id_col, *_NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(W.lean(run), f"`{id_col}` {kind}, {COLUMNS}")


def filter_documents(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST, clean_lines: bool = False) -> DataFrame:
    """The rows of docs that are kept, all columns; with clean_lines their texts lose the failing lines."""
    k = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            for lo, t in W.parts(b.column(k)):
                out, seen = _judge(t, max_lost)
                keep = out[6]
                part = b.slice(lo, t.n)
                if clean_lines:
                    good = ~seen["bad"]
                    texts: list = [[] for _ in range(t.n)]
                    raw = t.raw.tobytes()
                    for d, x, y in zip(seen["of"][good], seen["lo"][good], seen["hi"][good], strict=True):
                        texts[d].append(raw[x:y])
                    new = pa.array([b"\n".join(x) for x in texts], pa.binary()).cast(pa.string())
                    part = part.set_column(k, part.schema.field(k), new.cast(part.schema.field(k).type))
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(W.lean(run), docs.schema)
