"""Key and value encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrand.model import big_endian, compound, from_big_endian

__all__ = ["big_endian", "compound", "encode_json", "from_big_endian", "split_compound", "try_json", "year_index_key"]


def try_json(value: Column, schema: str) -> Column:
    """Decodes JSON; what does not decode is null, so that filters can keep it."""
    return F.from_json(value.cast("string"), schema)


def encode_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def split_compound(key: Column, part: int, by: str = "\0") -> Column:
    return F.get(F.split(key, f"[{by}]"), F.lit(part))


def year_index_key(year: Column, key: Column) -> Column:
    """A secondary-index key: the number big-endian, a zero byte, the primary key."""
    return F.concat(big_endian(year), F.unhex(F.lit("00")), F.encode(key, "UTF-8"))
