"""The data model: an ordered, versioned map from keys to values, as log rows.

A log row is (keyspace_id, key, seqno, batch_ord, kind, value).  Kinds: V a value,
T a tombstone, W a weak tombstone (reads take it for T), C the clearing of a whole
keyspace (its key is null).  Rows are ordered by (seqno, batch_ord); a reader at an
instant sees rows with seqno below it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE, TOMBSTONE, WEAK, CLEAR = "V", "T", "W", "C"
MAX_KEY, MAX_NAME, MAX_VALUE = 65_535, 255, 2**32 - 1
#: Overlay rows of a transaction come after everything in the base.
OVERLAY = 1 << 62


def log_schema(key: str = "binary", value: str = "binary") -> str:
    return f"keyspace_id long, key {key}, seqno long, batch_ord int, kind string, value {value}"


def successor(prefix: bytes) -> bytes | None:
    """The least string above all that start with prefix; None: there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


@dataclass(frozen=True)
class Range:
    """Bounds of keys; None is unbounded."""

    lo: object = None
    hi: object = None
    lo_incl: bool = True
    hi_incl: bool = False

    @classmethod
    def prefix(cls, p: bytes) -> Range:
        return cls(p or None, successor(p))

    def holds(self, key: Column) -> Column:
        """A predicate that Parquet readers can use for skipping."""
        out = F.lit(True)
        if self.lo is not None:
            out = key >= F.lit(self.lo) if self.lo_incl else key > F.lit(self.lo)
        if self.hi is not None:
            below = key <= F.lit(self.hi) if self.hi_incl else key < F.lit(self.hi)
            out = below if self.lo is None else out & below
        return out


def starts_with(key: Column, prefix: str | bytes) -> Column:
    """Prefix predicate: text keys push startswith down, binary keys a range."""
    return key.startswith(prefix) if isinstance(prefix, str) else Range.prefix(prefix).holds(key)


def big_endian(number: Column) -> Column:
    """Eight big-endian bytes of a non-negative long: the order of bytes is that of numbers."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def from_big_endian(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10).cast("long")


def compound(*parts: Column, by: str = "\0") -> Column:
    return F.concat_ws(by, *parts)


def check_key(key: bytes | str) -> None:
    n = len(key.encode() if isinstance(key, str) else key)
    if not 0 < n <= MAX_KEY:
        raise ValueError(f"a key has 1 to {MAX_KEY} bytes, not {n}")


def check_name(name: str) -> None:
    if not 0 < len(name.encode()) <= MAX_NAME:
        raise ValueError(f"a keyspace name has 1 to {MAX_NAME} bytes")


def as_log(df: DataFrame, kind: str | Column = VALUE, seqno: int | Column | None = None, keyspace: int | Column = 0, batch_ord: int | Column = 0) -> DataFrame:
    """df(key, value[, seqno]) as log rows."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(keyspace).cast("long").alias("keyspace_id"), "key", (F.col("seqno") if seqno is None else lit(seqno)).cast("long").alias("seqno"), lit(batch_ord).cast("int").alias("batch_ord"), lit(kind).alias("kind"), "value"
    )
