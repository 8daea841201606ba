"""JSON Pointers as Columns: encoded pointers are strings, decoded ones arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_token(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def decode_token(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def is_pointer(p: Column) -> Column:
    """Whether a string is a pointer: empty or with a leading slash, and 0 or 1 behind every `~`."""
    return ((p == "") | p.startswith("/")) & ~p.rlike("~(?![01])")


def segments(p: Column) -> Column:
    """Decoded segments, null if it is no pointer."""
    parts = F.split(p, "/", -1)
    return F.when(is_pointer(p), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode_token))


def from_segments(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat(F.lit("/"), encode_token(x))), "")


def push(p: Column, segment: Column) -> Column:
    return F.concat(p, F.lit("/"), encode_token(segment))


def pop(p: Column) -> Column:
    """Without the last segment; the root stays."""
    return F.regexp_replace(p, "/[^/]*$", "")


def truncate(p: Column, length: int) -> Column:
    """The first `length` segments."""
    return F.array_join(F.slice(F.split(p, "/", -1), 1, length + 1), "/")


def remove(p: Column, index: int) -> Column:
    """Without segment `index`; unchanged if there is none."""
    parts = F.split(p, "/", -1)
    rest = F.array_join(F.concat(F.slice(parts, 1, index + 1), F.slice(parts, index + 3, F.greatest(F.size(parts) - index - 2, F.lit(0)))), "/")
    return F.when(F.size(parts) > index + 1, rest).otherwise(p)


def length(p: Column) -> Column:
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/", -1)) - 1)


def segment_at(p: Column, index: int) -> Column:
    return F.get(segments(p), F.lit(index))


def display(p: Column) -> Column:
    return F.when(p == "", "root").otherwise(p)
