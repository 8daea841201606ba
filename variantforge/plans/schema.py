"""The schema model: a JSON Schema document as a tree of frozen nodes, with lenient and strict parsing."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from enum import Enum
from types import MappingProxyType
from typing import Any

from .values import InvalidJson, parse_json


class SchemaParseError(ValueError):
    """A document that is not a schema."""


class UnknownField(SchemaParseError):
    """A key that strict parsing does not know."""

    def __init__(self, key: str, path: str):
        super().__init__(f'unknown schema key "{key}" at {path}')
        self.key, self.path = key, path


class SchemaIoError(SchemaParseError):
    """A source that cannot be read."""


class SpecVersion(Enum):
    """Drafts by their meta-schema URI (fixed values)."""

    DRAFT_00 = "http://json-schema.org/draft-00/hyper-schema#"
    DRAFT_01 = "http://json-schema.org/draft-01/hyper-schema#"
    DRAFT_02 = "http://json-schema.org/draft-02/hyper-schema#"
    DRAFT_03 = "http://json-schema.org/draft-03/schema#"
    DRAFT_04 = "http://json-schema.org/draft-04/schema#"
    DRAFT_05 = "http://json-schema.org/draft-05/schema#"
    DRAFT_06 = "http://json-schema.org/draft-06/schema#"
    DRAFT_07 = "http://json-schema.org/draft-07/schema#"
    DRAFT_2019_09 = "https://json-schema.org/draft/2019-09/schema"
    DRAFT_2020_12 = "https://json-schema.org/draft/2020-12/schema"

    @property
    def schema_uri(self) -> str:
        return self.value

    @classmethod
    def from_schema_uri(cls, uri: str) -> SpecVersion | None:
        uri = uri.strip().rstrip("/")
        return SPEC_URIS.get(uri)

    def default_settings(self) -> SchemaSettings:
        """Settings are alike for every draft."""
        return SchemaSettings()


#: Every spelling of a meta-schema URI that names a draft.
SPEC_URIS: Mapping[str, SpecVersion] = MappingProxyType(
    {v.value: v for v in SpecVersion} | {"http://json-schema.org/schema#": SpecVersion.DRAFT_04}
)


@dataclass(frozen=True)
class SchemaSettings:
    """disallow_unknown_fields: strict parsing; spec_version: overrides a schema's own `$schema`."""

    disallow_unknown_fields: bool = False
    spec_version: SpecVersion | None = None

    def resolved_spec_version(self, schema: Schema | None = None) -> SpecVersion:
        """Explicit, else the schema's, else 2020-12."""
        own = SpecVersion.from_schema_uri(schema.schema) if schema and schema.schema else None
        return self.spec_version or own or SpecVersion.DRAFT_2020_12


class Extra(Enum):
    """additionalProperties as a bare boolean."""

    ALLOW = True
    FORBID = False


_EMPTY: Mapping = MappingProxyType({})


@dataclass(frozen=True)
class Schema:
    """One schema node; None means that the keyword is absent."""

    schema: str | None = None
    id: str | None = None
    ref: str | None = None
    type: str | None = None
    defs: Mapping[str, Schema] | None = None
    definitions: Mapping[str, Schema] | None = None
    properties: Mapping[str, Schema] = field(default_factory=lambda: _EMPTY)
    additional_properties: Extra | Schema | None = None
    required: tuple[str, ...] | None = None
    title: str | None = None
    description: str | None = None
    comment: str | None = None
    enum: tuple | None = None
    const: Any = None
    items: Schema | None = None
    unique_items: bool | None = None
    min_items: int | None = None
    max_items: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    format: str | None = None
    default: Any = None
    deprecated: bool | None = None
    examples: tuple | None = None
    all_of: tuple[Schema, ...] | None = None
    any_of: tuple[Schema, ...] | None = None
    one_of: tuple[Schema, ...] | None = None

    # Sources

    @classmethod
    def of(cls, source, settings: SchemaSettings = SchemaSettings()) -> Schema:
        """A schema from a dict, JSON text or bytes, an open file, or a path object."""
        if isinstance(source, Schema):
            return source
        if isinstance(source, os.PathLike):
            try:
                with open(source, "rb") as f:
                    source = f.read()
            except OSError as e:
                raise SchemaIoError(f"io error: {e}") from e
        elif isinstance(source, io.IOBase) or hasattr(source, "read"):
            try:
                source = source.read()
            except OSError as e:
                raise SchemaIoError(f"io error: {e}") from e
        if isinstance(source, (bytes, bytearray)):
            try:
                source = source.decode()
            except UnicodeDecodeError as e:
                raise SchemaParseError(f"invalid JSON Schema: {e}") from e
        if isinstance(source, str):
            try:
                source = parse_json(source)
            except InvalidJson as e:
                raise SchemaParseError(f"invalid JSON Schema: {e}") from e
        return _node(source, settings.disallow_unknown_fields, "root")

    # Output

    def to_dict(self, whole: bool = False) -> dict:
        """The schema as JSON values, keywords in the model's order; absent and empty ones are left out.

        With whole, empty ones stay: an empty anyOf or oneOf refuses everything and an empty allOf has no
        mapping, so only the whole text reads back as the same schema.
        """
        out = {}
        for word, (name, _, write) in KEYWORDS.items():
            value = getattr(self, name)
            if value is not None and (name not in _DROP_EMPTY or len(value) or whole and name != "properties"):
                out[word] = write(value, whole)
        return out

    def to_json(self, whole: bool = False) -> str:
        return json.dumps(self.to_dict(whole), ensure_ascii=False, separators=(",", ":"))

    def with_(self, **changes) -> Schema:
        return replace(self, **changes)

    # Predicates

    @property
    def is_object_with_properties(self) -> bool:
        return self.type == "object" and bool(self.properties)

    @property
    def is_array_with_items(self) -> bool:
        return self.type == "array" and self.items is not None

    @property
    def is_string(self) -> bool:
        return self.type == "string"

    @property
    def is_integer(self) -> bool:
        return self.type == "integer"

    @property
    def is_number(self) -> bool:
        return self.type == "number"

    @property
    def is_boolean(self) -> bool:
        return self.type == "boolean"

    @property
    def is_uuid(self) -> bool:
        return self.type == "string" and self.format == "uuid"

    @property
    def is_string_enum(self) -> bool:
        return bool(self.enum) and all(isinstance(x, str) for x in self.enum)

    @property
    def is_string_const(self) -> bool:
        return isinstance(self.const, str)

    def is_required(self, key: str) -> bool:
        return key in (self.required or ())


# Parsing: one reader and one writer for each keyword


def _fail(path: str, what: str):
    raise SchemaParseError(f"invalid JSON Schema: {what} at {path}")


def _typed(kind: type, what: str) -> Callable:
    def read(v, strict, path):
        return v if type(v) is kind else _fail(path, f"expected {what}")

    return read


def _size(v, strict, path):
    return v if type(v) is int and 0 <= v < 1 << 64 else _fail(path, "expected a non-negative integer")


def _bound(v, strict, path):
    return float(v) if type(v) in (int, float) else _fail(path, "expected a number")


def _strings(v, strict, path):
    return tuple(v) if isinstance(v, list) and all(isinstance(x, str) for x in v) else _fail(path, "expected a list of strings")


def _values(v, strict, path):
    return tuple(v) if isinstance(v, list) else _fail(path, "expected a list")


def _any(v, strict, path):
    return v


def _type(v, strict, path):
    if isinstance(v, list):
        names = _strings(v, strict, path)
        return names[0] if names else None
    return v if isinstance(v, str) else _fail(path, "expected a string or a list of strings")


def _extra(v, strict, path):
    if isinstance(v, bool):
        return Extra(v)
    return _node(v, False, path) if isinstance(v, dict) else _fail(path, "expected a boolean or an object")


def _schema_map(v, strict, path):
    if not isinstance(v, dict):
        _fail(path, "expected an object")
    return MappingProxyType({k: _node(v[k], strict, f"{path}/{k}") for k in sorted(v)})


def _schema_list(v, strict, path):
    return tuple(_node(x, strict, f"{path}/{i}") for i, x in enumerate(v)) if isinstance(v, list) else _fail(path, "expected a list")


def _one_schema(v, strict, path):
    return _node(v, strict, path)


_same = lambda v, whole: v
_write_list = lambda v, whole: list(v)
_write_one = lambda v, whole: v.to_dict(whole)
_write_all = lambda v, whole: [x.to_dict(whole) for x in v]
_write_map = lambda v, whole: {k: x.to_dict(whole) for k, x in v.items()}
_write_extra = lambda v, whole: v.value if isinstance(v, Extra) else v.to_dict(whole)
_write_bound = _same
_text, _flag = _typed(str, "a string"), _typed(bool, "a boolean")

#: The keywords, as keyword -> (field, reader, writer), in the model's order.
KEYWORDS: Mapping[str, tuple[str, Callable, Callable]] = MappingProxyType(
    {
        "$schema": ("schema", _text, _same),
        "$id": ("id", _text, _same),
        "$ref": ("ref", _text, _same),
        "type": ("type", _type, _same),
        "$defs": ("defs", _schema_map, _write_map),
        "definitions": ("definitions", _schema_map, _write_map),
        "properties": ("properties", _schema_map, _write_map),
        "additionalProperties": ("additional_properties", _extra, _write_extra),
        "required": ("required", _strings, _write_list),
        "title": ("title", _text, _same),
        "description": ("description", _text, _same),
        "$comment": ("comment", _text, _same),
        "enum": ("enum", _values, _write_list),
        "const": ("const", _any, _same),
        "items": ("items", _one_schema, _write_one),
        "uniqueItems": ("unique_items", _flag, _same),
        "minItems": ("min_items", _size, _same),
        "maxItems": ("max_items", _size, _same),
        "minimum": ("minimum", _bound, _write_bound),
        "maximum": ("maximum", _bound, _write_bound),
        "minLength": ("min_length", _size, _same),
        "maxLength": ("max_length", _size, _same),
        "pattern": ("pattern", _text, _same),
        "format": ("format", _text, _same),
        "default": ("default", _any, _same),
        "deprecated": ("deprecated", _flag, _same),
        "examples": ("examples", _values, _write_list),
        "allOf": ("all_of", _schema_list, _write_all),
        "anyOf": ("any_of", _schema_list, _write_all),
        "oneOf": ("one_of", _schema_list, _write_all),
    }
)
_DROP_EMPTY = {"required", "enum", "defs", "definitions", "all_of", "any_of", "one_of", "properties"}
assert [f.name for f in fields(Schema)] == [name for name, _, _ in KEYWORDS.values()]


def _node(v, strict: bool, path: str) -> Schema:
    if not isinstance(v, dict):
        _fail(path, "expected an object")
    found = {}
    for word, value in v.items():
        known = KEYWORDS.get(word)
        if known is None:
            if strict:
                raise UnknownField(word, path)
            continue
        if value is None:  # null counts as absent, for const and default too
            if known[0] == "properties":
                _fail(f"{path}/{word}", "expected an object")
            continue
        found[known[0]] = known[1](value, strict, f"{path}/{word}")
    return Schema(**found)
