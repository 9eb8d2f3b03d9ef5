"""Fixed-point numbers, hashes and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousandths(x: Column) -> Column:
    """x times 1000, halves up (also below zero, unlike round())."""
    return F.floor(x * 1000 + 0.5).cast("bigint")


def thousandths_floor(x: Column) -> Column:
    return F.floor(x * 1000).cast("bigint")


def hundredths(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("bigint")


def tuple_hash(rel: str, *columns: tuple[Column, str]) -> Column:
    """First 16 hex digits of the SHA-256 of a relation's name and its typed values."""
    parts = [F.concat(F.lit("s:" if kind == "symbol" else "n:"), c.cast("string")) for c, kind in columns]
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(rel), *parts).cast("binary"), 256), 1, 16)


def glob_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` do not; the whole path has to match."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def strip_comments(text: Column) -> Column:
    """Without block and line comments, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def singular(name: Column) -> Column:
    return (
        F.when(name.rlike("ies$"), F.regexp_replace(name, "ies$", "y"))
        .when(name.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(name, "es$", ""))
        .when(name.rlike("[^s]s$"), F.regexp_replace(name, "s$", ""))
        .otherwise(name)
    )


def query_key(value: str | int | float | tuple) -> str:
    """Typed encoding of a memo key: text, finite number or a tuple of them."""
    from ..lang import DatalogError

    if isinstance(value, bool) or not isinstance(value, str | int | float | tuple):
        raise DatalogError("key.invalidType", f"{value!r} cannot be a key")
    if isinstance(value, str):
        return f"s\0{value}"
    if isinstance(value, tuple):
        return "t\1" + "\1".join(query_key(v) for v in value)
    if value != value or value in (float("inf"), float("-inf")):
        raise DatalogError("key.notFinite", f"{value!r} is not finite")
    return f"n\0{value}"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes, as a long: the affinity by which work is dealt to a fixed number of workers."""
    octets = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    step = lambda h, x: ((h.bitwiseXOR(F.conv(x, 16, 10).cast("bigint"))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), step)


def age_text(seconds: Column) -> Column:
    """How long ago, in the largest unit that fills up: ``3 days ago``."""
    out = F.concat(seconds.cast("string"), F.lit(" seconds ago"))
    for size, unit in ((60, "minute"), (3600, "hour"), (86400, "day"), (604800, "week"), (2629800, "month"), (31557600, "year")):
        n = F.floor(seconds / size)
        out = F.when(n >= 1, F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))).otherwise(out)
    return out
