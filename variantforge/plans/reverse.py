"""Spark types as schemas: a StructType, with the metadata of its fields, as a JSON Schema."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from types import MappingProxyType

from pyspark.sql import types as T

from . import names
from .models import F32_MAX
from .schema import Extra, Schema, SpecVersion

F64_MAX = 1.7976931348623157e308
#: Logical integer types -> bits, signed.
_INTS = {"i8": (7, True), "u8": (8, False), "i16": (15, True), "u16": (16, False), "i32": (31, True), "u32": (32, False), "i64": (63, True), "u64": (64, False)}
_SPARK_INTS = {T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64"}
#: Field metadata that overrides or adds keywords.
OVERRIDES = ("minimum", "maximum", "min_items", "max_items", "min_length", "max_length", "pattern", "deprecated", "default", "title", "id", "description", "comment")


class UnsupportedType(TypeError):
    """A type that has no schema."""


#: Schemas of users' own types: type -> function of the type.
_OWN: dict[type, Callable[[T.DataType], Schema]] = {}


def register_type(kind: type, schema: Callable[[T.DataType], Schema]) -> None:
    """Fields of a Spark type (or user-defined type) of this class get the schema that the function makes of it."""
    _OWN[kind] = schema


def schema_of_enum(kind: type[Enum]) -> Schema:
    """An enumeration of plain names: a const if there is one, else an enum; members that carry other data are refused."""
    values = tuple(m.value for m in kind)
    if not values or not all(isinstance(v, str) for v in values):
        raise UnsupportedType(f"{kind.__name__}: members must be plain strings")
    return Schema(const=values[0]) if len(values) == 1 else Schema(enum=values)


def _bounded(kind: str, low: float, high: float) -> Schema:
    return Schema(type=kind, minimum=float(low), maximum=float(high))


def schema_for(kind: T.DataType, meta: dict | None = None, defs: dict[str, Schema] | None = None, hint: str = "Unnamed", inline: bool = False) -> Schema:
    """The schema of one Spark type; nested structs go to defs unless inline."""
    meta = meta or {}
    own = next((f for c, f in _OWN.items() if isinstance(kind, c)), None) or (getattr(kind, "json_schema", None) and (lambda k: k.json_schema()))
    if own is not None:
        made = Schema.of(own(kind))
        if made.defs and defs is not None:
            for name, node in made.defs.items():
                defs.setdefault(name, node)
            made = made.with_(defs=None)
        return made
    if isinstance(kind, T.UserDefinedType):
        return schema_for(kind.sqlType(), meta, defs, hint, inline)
    logical = str(meta.get("logical", "")).removeprefix("Option<").rstrip(">")
    if isinstance(kind, T.StringType):
        values = meta.get("enum")
        if values:
            if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                raise UnsupportedType(f"{hint}: enum values must be plain strings")
            return Schema(const=values[0]) if len(values) == 1 else Schema(enum=tuple(values))
        return Schema(type="string", format=meta.get("format"))
    if isinstance(kind, T.BooleanType):
        return Schema(type="boolean")
    if isinstance(kind, T.FloatType):
        return _bounded("number", -F32_MAX, F32_MAX)
    if isinstance(kind, T.DoubleType):
        return _bounded("number", -F64_MAX, F64_MAX)
    if type(kind) in _SPARK_INTS or isinstance(kind, T.DecimalType) and kind.scale == 0:
        bits, signed = _INTS[logical if logical in _INTS else _SPARK_INTS.get(type(kind), "u64")]
        return _bounded("integer", -(2**bits) if signed else 0, 2**bits - 1)
    if isinstance(kind, T.DecimalType):
        return Schema(type="number")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Schema(type="string")
    if isinstance(kind, T.ArrayType):
        item = schema_for(kind.elementType, None, defs, hint, inline)
        return Schema(type="array", items=item, unique_items=True if meta.get("unique_items") or meta.get("uniqueItems") else None)
    if isinstance(kind, T.MapType):
        return Schema(type="object", additional_properties=schema_for(kind.valueType, None, defs, hint, inline))
    if isinstance(kind, T.StructType):
        if defs is None or inline:
            return _object(kind, defs)
        name = names.type_name(meta.get("model") or hint)
        own = _object(kind, defs)
        number = 1
        while defs.setdefault(name if number == 1 else f"{name}{number}", own) != own:
            number += 1
        return Schema(ref=f"#/$defs/{name if number == 1 else f'{name}{number}'}")
    return Schema()


def _object(kind: T.StructType, defs: dict[str, Schema] | None) -> Schema:
    properties, required = {}, []
    extra: Extra | Schema = Extra.FORBID
    for f in kind.fields:
        meta = dict(f.metadata or {})
        key = meta.get("rename") or (meta.get("json_key") if meta.get("json_key") not in (None, "*") else f.name)
        if meta.get("json_key") == "*" and isinstance(f.dataType, T.MapType):
            extra = schema_for(f.dataType.valueType, None, defs, f.name)
            continue
        changes = {k: meta[k] for k in OVERRIDES if meta.get(k) is not None}
        for k in ("minimum", "maximum"):
            if k in changes:
                changes[k] = float(changes[k])
        node = schema_for(f.dataType, meta, defs, f.name, inline=bool(changes))
        properties[key] = node.with_(**changes) if changes else node
        if not f.nullable or meta.get("required"):
            required.append(key)
    return Schema(type="object", properties=MappingProxyType(dict(sorted(properties.items()))), required=tuple(required) or None, additional_properties=extra)


def schema_from_struct(kind: T.StructType, title: str | None = None, id: str | None = None, description: str | None = None, comment: str | None = None) -> Schema:
    """A closed object schema of a StructType: 2020-12, required what is not nullable, nested structs under `$defs`.

    Of equal nested structs one definition stays; different ones of one name are numbered.
    """
    defs: dict[str, Schema] = {}
    root = _object(kind, defs)
    return root.with_(schema=SpecVersion.DRAFT_2020_12.schema_uri, id=id, title=title, description=description, comment=comment, defs=MappingProxyType(dict(sorted(defs.items()))) or None)


def hoist_defs(root: Schema) -> Schema:
    """root with the `$defs` of all nested schemas moved to its own; of one name the first met stays."""
    found = dict(root.defs or {})

    def strip(node: Schema, top: bool = False) -> Schema:
        if not top:
            for k, v in (node.defs or {}).items():
                found.setdefault(k, v)
        change = {} if top else {"defs": None}
        if node.properties:
            change["properties"] = MappingProxyType({k: strip(v) for k, v in node.properties.items()})
        if node.items is not None:
            change["items"] = strip(node.items)
        if isinstance(node.additional_properties, Schema):
            change["additional_properties"] = strip(node.additional_properties)
        for word in ("all_of", "any_of", "one_of"):
            if getattr(node, word):
                change[word] = tuple(strip(x) for x in getattr(node, word))
        return node.with_(**change)

    out = strip(root, top=True)
    done: dict[str, Schema] = {}
    while todo := [k for k in found if k not in done]:
        for k in todo:
            done[k] = strip(found[k])
    return out.with_(defs=MappingProxyType(dict(sorted(done.items()))) if done else root.defs)
