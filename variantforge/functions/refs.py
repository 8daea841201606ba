"""References and meta-schema URIs as Columns, for corpora of schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import SPEC_URIS
from .pointer import decode_token


def ref_kind(ref: Column) -> Column:
    """Root, Defs, Definitions, or the error's name."""
    steps = F.split(ref, "/", -1)
    name = F.get(steps, F.lit(2))
    shaped = (F.size(steps) == 3) & (F.get(steps, F.lit(0)) == "#") & (F.get(steps, F.lit(1)) != "") & (name != "")
    return (
        F.when(ref.isin("", "#"), "Root")
        .when(~ref.startswith("#"), "UnsupportedRef")
        .when(~shaped, "UnsupportedFragment")
        .when(name.rlike("~(?![01])"), "InvalidPointerEscape")
        .when(F.get(steps, F.lit(1)) == "$defs", "Defs")
        .when(F.get(steps, F.lit(1)) == "definitions", "Definitions")
        .otherwise("UnsupportedFragment")
    )


def ref_name(ref: Column) -> Column:
    """The decoded definition name of a Defs or Definitions reference, else null."""
    return F.when(ref_kind(ref).isin("Defs", "Definitions"), decode_token(F.get(F.split(ref, "/", -1), F.lit(2))))


def spec_version(uri: Column) -> Column:
    """The draft's name of a `$schema` URI, null if unknown."""
    plain = F.rtrim(F.btrim(uri, F.lit(" \t\n\r")), F.lit("/"))
    out = F.lit(None).cast("string")
    for known, version in SPEC_URIS.items():
        out = F.when(plain == known, version.name).otherwise(out)
    return out


def resolved_spec_version(uri: Column, explicit: Column | None = None) -> Column:
    own = F.coalesce(spec_version(uri), F.lit("DRAFT_2020_12"))
    return own if explicit is None else F.coalesce(explicit, own)
