"""Hashes and hash-seeded random numbers that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_hash(pairs: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a map's entries, written as compact JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(pairs))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(F.struct(e["value"].alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["value"].alias("v")))) - 6))), ",")
    return F.substring(sha256_text(F.concat(F.lit("{"), body, F.lit("}"))), 1, length)


def digits(text: Column, n: int = 13) -> Column:
    """The first n (up to 15) hex digits of the text's MD5 as a bigint."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of parts joined by colons."""
    return digits(F.concat_ws(":", *[p.cast("string") for p in parts])) / F.lit(float(1 << 52))


def unit_sql(*parts: str) -> str:
    """unit() in DuckDB's SQL."""
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 13) AS BIGINT) / 4503599627370496e0"


def draw(n: Column, *parts: Column) -> Column:
    """A number in 1..n hashed from parts."""
    return (F.floor(unit(*parts) * n) + 1).cast("long")
