"""Structural keys of object schemas: equal keys mean one shared model."""

from __future__ import annotations

import hashlib
from enum import Enum

from .schema import Extra, Schema
from .values import canonical


class DedupeMode(Enum):
    """DISABLED shares nothing; FUNCTIONAL ignores ids, descriptions, comments, deprecation and examples; FULL counts them."""

    DISABLED = "disabled"
    FUNCTIONAL = "functional"
    FULL = "full"


def projection(schema: Schema, mode: DedupeMode, strict: bool = False) -> dict:
    """What counts of a schema, recursively, absent keywords left out.

    Bounds, enum, const, references and combinators do not count unless strict.
    """
    go = lambda s: projection(s, mode, strict)
    out = {
        "type": schema.type,
        "properties": {k: go(v) for k, v in schema.properties.items()},
        "required": None if schema.required is None else list(schema.required),
        "title": schema.title,
        "default": schema.default,
        "additionalProperties": None if schema.additional_properties is None else schema.additional_properties.value if isinstance(schema.additional_properties, Extra) else go(schema.additional_properties),
    }
    if schema.type == "array":
        out |= {"items": None if schema.items is None else go(schema.items), "uniqueItems": schema.unique_items, "minItems": schema.min_items, "maxItems": schema.max_items}
    if schema.type == "string":
        out |= {"minLength": schema.min_length, "maxLength": schema.max_length, "pattern": schema.pattern, "format": schema.format}
    if mode is DedupeMode.FULL:
        out |= {"$id": schema.id, "description": schema.description, "$comment": schema.comment, "deprecated": schema.deprecated, "examples": None if schema.examples is None else list(schema.examples)}
    if strict:
        branches = {w: [go(s) for s in x] for w, x in (("allOf", schema.all_of), ("anyOf", schema.any_of), ("oneOf", schema.one_of)) if x is not None}
        out |= branches | {"minimum": schema.minimum, "maximum": schema.maximum, "const": schema.const, "$ref": schema.ref, "enum": None if schema.enum is None else list(schema.enum)}
    return {k: v for k, v in out.items() if v is not None and v != {}}


def dedupe_key(schema: Schema, mode: DedupeMode = DedupeMode.FULL, strict: bool = False) -> str:
    """Canonical text of the projection; texts order keys."""
    return canonical(projection(schema, mode, strict))


def dedupe_hash(schema: Schema, mode: DedupeMode = DedupeMode.FULL, strict: bool = False) -> str:
    return hashlib.sha256(dedupe_key(schema, mode, strict).encode()).hexdigest()
