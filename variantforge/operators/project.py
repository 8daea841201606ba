"""Typed projection: JSON documents as columns of a schema's StructType, defaults filled in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.models import MappingSettings, struct_type
from .columns import fresh, named
from .compile import member


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind) if not isinstance(value, (list, dict)) else F.from_json(F.lit(json.dumps(value)), kind.simpleString())


def _value(v: Column, kind: T.DataType) -> Column:
    """A variant as a type: null where the value is of another JSON type."""
    if isinstance(kind, T.VariantType):
        return v
    if isinstance(kind, T.StructType):
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), struct_of(v, kind))
    if isinstance(kind, T.ArrayType):
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.transform(v.cast("array<variant>"), lambda e: _value(e, kind.elementType)))
    if isinstance(kind, T.MapType):
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), _values(v.cast("map<string,variant>"), kind.valueType))
    s = F.schema_of_variant(v)
    if isinstance(kind, T.StringType):
        return F.when(s == "STRING", F.variant_get(v, "$", "string"))
    if isinstance(kind, T.BooleanType):
        return F.when(s == "BOOLEAN", F.variant_get(v, "$", "boolean"))
    number = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(number, F.try_variant_get(v, "$", kind.simpleString()))
    integer = (s == "BIGINT") | (s.startswith("DECIMAL") & s.endswith(",0)") & F.lit(isinstance(kind, T.DecimalType)))
    return F.when(integer, F.try_variant_get(v, "$", kind.simpleString()))


def _values(entries: Column, kind: T.DataType) -> Column:
    return F.transform_values(entries, lambda _, e: _value(e, kind))


def struct_of(v: Column, kind: T.StructType) -> Column:
    """An object variant as a struct. Defaults stand in only for absent keys; `additional` takes the keys not named."""
    known = [f.metadata.get("json_key", f.name) for f in kind if f.metadata.get("json_key") != "*"]
    cols = []
    for f in kind:
        if f.metadata.get("json_key") == "*":
            rest = F.map_filter(v.cast("map<string,variant>"), lambda k, _: ~k.isin(*known))
            col = _values(rest, f.dataType.valueType)
        else:
            found = member(v, f.metadata.get("json_key", f.name))
            col = _value(found, f.dataType)
            if f.metadata.get("default") is not None:
                col = F.when(found.isNull(), _literal(f.metadata["default"], f.dataType)).otherwise(col)
        cols.append(col.alias(f.name, metadata=dict(f.metadata)) if f.metadata else col.alias(f.name))
    return F.struct(*cols)


def typed_projection(df: DataFrame, doc_col: str, schema, settings: MappingSettings = MappingSettings(), into: str = "typed") -> DataFrame:
    """df with the document as a typed struct, in place of any column so named; null for null, text that is not JSON, or no object."""
    kind = struct_type(schema, settings)
    own = fresh([*df.columns, into])
    parsed = df.select("*", F.try_parse_json(named(doc_col)).alias(own))
    return parsed.select(*[named(c) for c in df.columns if c != into], F.when(F.col(own).isNotNull(), _value(F.col(own), kind)).alias(into))
