"""Validation of a column of JSON documents against a schema."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from ..plans.errors import ERROR_FIELDS, ERROR_TYPE
from ..plans.schema import Schema
from ..plans.values import InvalidJson, parse_json
from .columns import fresh, map_in_arrow, named
from .compile import NotCompilable, compile_errors, message, staged_errors, with_messages
from .interpret import ValidationOptions, check_terminates, validate

ERRORS, INVALID = "errors", "invalid_json"
_WHITE = " \n\r\t"


def errors_column(doc: Column, schema, options: ValidationOptions = ValidationOptions()) -> Column:
    """Errors of a JSON string column as one expression; raises NotCompilable where only the interpreter is exact."""
    return compile_errors(Schema.of(schema), F.try_parse_json(doc), options)


def is_valid(doc: Column, schema, options: ValidationOptions = ValidationOptions()) -> Column:
    """True for a valid document, false for an invalid one or text that is not JSON, null for null."""
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull() & (F.size(errors_column(doc, schema, options)) == 0))


def broken_json(doc: Column, parsed: Column | None = None) -> Column:
    """Text that is not one JSON value, as far as the parser tells; a bracket that the text does not end with counts."""
    text = F.btrim(doc, F.lit(_WHITE))
    closes = ~(text.startswith("{") & ~text.endswith("}")) & ~(text.startswith("[") & ~text.endswith("]"))
    return doc.isNotNull() & ((F.try_parse_json(doc) if parsed is None else parsed).isNull() | ~closes)


def _root_kind(doc: Column, v: Column) -> Column:
    """The text of a document's type from its first character; only numbers need the parsed value."""
    first = F.substring(F.ltrim(doc, F.lit(_WHITE)), 1, 1)
    return F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING").when(first.isin("t", "f"), "BOOLEAN").when(first == "n", "VOID").otherwise(F.schema_of_variant(v))


def validate_documents(df: DataFrame, doc_col: str, schema, tier: str = "auto", options: ValidationOptions = ValidationOptions(), messages: bool = False) -> DataFrame:
    """df with `errors` (array of error structs, in order) and `invalid_json`, in place of any columns so named.

    tier: `compiled` (Columns over VARIANT), `interpreted` (Arrow batches through the interpreter, exact in
    every case), or `auto`, compiled where it can be. A null document has no errors; one that is not JSON
    has none either and is marked. No shuffle: one narrow pass, in batch and in streams. With messages, each
    error has its message too; without, ``explode_errors`` writes them for those who read them.
    """
    schema = Schema.of(schema)
    check_terminates(schema)
    kept = [c for c in df.columns if c not in (ERRORS, INVALID)]
    doc = named(doc_col)
    found = None
    if tier != "interpreted":
        own = fresh(df.columns)
        try:
            levels, errors = staged_errors(schema, f"{own}r", f"{own}k", f"{own}c", options)
        except NotCompilable:
            if tier == "compiled":
                raise
        else:
            found = df.select("*", F.try_parse_json(doc).alias(f"{own}r"))
            found = found.select("*", _root_kind(doc, F.col(f"{own}r")).alias(f"{own}k"))
            for level in levels:
                found = found.select("*", *[c.alias(n) for n, c in level.items()])
            found = found.select(*[named(c) for c in kept], errors.alias(ERRORS), broken_json(doc, F.col(f"{own}r")).alias(INVALID))
    if found is None:
        found = _interpreted(df, doc_col, kept, schema, options)
    return found.withColumn(ERRORS, with_messages(F.col(ERRORS))) if messages else found


def _interpreted(df: DataFrame, doc_col: str, kept: list[str], schema: Schema, options: ValidationOptions) -> DataFrame:
    own = fresh(df.columns)
    plain = df.select(*[named(c) for c in kept], named(doc_col).alias(own))
    kind = pa.list_(to_arrow_type(ERROR_TYPE))
    text = schema.to_json(whole=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Schema.of(text)
        for batch in batches:
            errors, invalid = [], []
            for doc in batch.column(len(kept)).to_pylist():
                try:
                    errors.append([] if doc is None else validate(root, parse_json(doc, max_depth=None), options))
                    invalid.append(False)
                except InvalidJson:
                    errors.append([])
                    invalid.append(True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(errors, kind), pa.array(invalid, pa.bool_())], names=[*kept, ERRORS, INVALID])

    return map_in_arrow(plain, run, StructType([*plain.schema.fields[: len(kept)], StructField(ERRORS, ArrayType(ERROR_TYPE)), StructField(INVALID, BooleanType())]))


def explode_errors(validated: DataFrame, *keys: str) -> DataFrame:
    """One row per error: keys, ord (its place from 0), the error's fields and its message, which costs nothing unless it is read.

    The array is exploded as an expression: exploded as a column, Spark would add a filter on its size and
    evaluate the checks a second time for it.
    """
    some = F.when(F.size(ERRORS) > 0, F.col(ERRORS))
    own = fresh([*keys])
    rows = validated.select(*[named(k) for k in keys], F.posexplode(some).alias("ord", own))
    e = F.col(own)
    return rows.select(*[named(k) for k in keys], "ord", *[e[n].alias(n) for n in ERROR_FIELDS], message(e).alias("message"))


def error_summary(validated: DataFrame) -> DataFrame:
    """Errors by kind and path: kind, path, n_errors, n_documents; partial counts are combined before they move."""
    per_document = validated.select(F.explode(F.array_distinct(F.transform(ERRORS, lambda e: F.struct(e["kind"].alias("kind"), e["path"].alias("path"))))).alias("e"), ERRORS)
    counted = per_document.select("e.kind", "e.path", F.size(F.filter(ERRORS, lambda x: (x["kind"] == F.col("e.kind")) & (x["path"] == F.col("e.path")))).alias("n"))
    return counted.groupBy("kind", "path").agg(F.sum("n").alias("n_errors"), F.count("*").alias("n_documents"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) documents."""
    bad = F.col(INVALID) | (F.size(ERRORS) > 0)
    return validated.where(~bad), validated.where(bad)
