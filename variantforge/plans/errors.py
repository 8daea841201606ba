"""Validation errors as rows: one struct type for all kinds, and their messages, which are written only where they are read.

Fields hold what a kind needs: `property` a key, a pattern or a reference; `expected` and `actual` text;
`allowed` the enum; n_* counts and d_* numbers, expected first.
"""

from __future__ import annotations

from pyspark.sql import types as T

from .values import plain_number

ERROR_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "path", "property", "expected", "actual")]
    + [T.StructField("allowed", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.LongType()) for n in ("n_expected", "n_actual")]
    + [T.StructField(n, T.DoubleType()) for n in ("d_expected", "d_actual")]
)
ERROR_FIELDS = tuple(f.name for f in ERROR_TYPE)

#: Message of each kind after `{loc}: `; {d_*} are written without exponent, {allowed} joined by commas.
MESSAGES = {
    "InvalidRef": 'could not resolve $ref "{property}": {expected}',
    "ExpectedObject": "expected object, got {actual}",
    "ExpectedString": "expected string, got {actual}",
    "ExpectedInteger": "expected integer, got {actual}",
    "ExpectedNumber": "expected number, got {actual}",
    "ExpectedArray": "expected array, got {actual}",
    "ExpectedBoolean": "expected boolean, got {actual}",
    "DuplicateArrayItems": "array has duplicate items (value: {actual})",
    "TooFewItems": "array has {n_actual} item(s), minimum is {n_expected}",
    "TooManyItems": "array has {n_actual} item(s), maximum is {n_expected}",
    "MissingRequired": 'missing required property "{property}"',
    "DisallowedAdditionalProperty": 'additional property "{property}" not allowed',
    "NotInEnum": "value {actual} not in enum (allowed: {allowed})",
    "NotConst": "value {actual} does not match const (expected: {expected})",
    "BelowMinimum": "value {d_actual} is below minimum {d_expected}",
    "AboveMaximum": "value {d_actual} is above maximum {d_expected}",
    "TooShort": "string has {n_actual} code points, minLength is {n_expected}",
    "TooLong": "string has {n_actual} code points, maxLength is {n_expected}",
    "PatternMismatch": 'string "{actual}" does not match pattern "{property}"',
    "InvalidPatternInSchema": 'schema has invalid pattern "{property}"',
    "InvalidUuidFormat": 'string "{actual}" is not a valid UUID',
    "NoSubschemaMatched": "instance does not match any of the {n_expected} subschema(s)",
    "MultipleSubschemasMatched": "instance matches {n_actual} of the {n_expected} oneOf subschema(s), exactly one required",
}


def error(kind: str, path: str, **payload) -> dict:
    """An error row; fields that are not given are None."""
    return dict.fromkeys(ERROR_FIELDS) | {"kind": kind, "path": path} | payload


def message(row: dict) -> str:
    """The message of an error row."""
    shown = {k: plain_number(v) if k.startswith("d_") and v is not None else ", ".join(v) if k == "allowed" and v is not None else v for k, v in row.items()}
    return f"{row['path'] or 'root'}: " + MESSAGES[row["kind"]].format(**shown)
