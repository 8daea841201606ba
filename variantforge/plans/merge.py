"""allOf as one object schema, for type mapping only; validation never merges."""

from __future__ import annotations

from types import MappingProxyType

from .schema import Schema
from .values import canonical


class MappingError(ValueError):
    """A schema that has no type mapping."""


class RootNotObject(MappingError):
    def __init__(self):
        super().__init__('root schema must have type "object" and non-empty properties')


class BatchError(MappingError):
    """The first failing schema of a batch."""

    def __init__(self, index: int, cause: MappingError):
        super().__init__(f"schema at index {index}: {cause}")
        self.index, self.cause = index, cause


class EmptyCombinator(MappingError):
    def __init__(self, word: str):
        super().__init__(f"{word} is present but empty (no subschemas{' to merge' if word == 'allOf' else ''})")


class NotObjectLike(MappingError):
    def __init__(self, index: int):
        super().__init__(f'allOf subschema at index {index} is not object-like (need type "object" or non-empty properties)')
        self.index = index


class Conflict(MappingError):
    """Branches that disagree on a property: `what` is types, minimum/maximum, enum values, const values or pattern."""

    def __init__(self, key: str, what: str):
        where = "in subschemas at indices []" if what == "types" else "across subschemas"
        super().__init__(f'allOf merge: property "{key}" has conflicting {what} {where}')
        self.key, self.what = key, what


class RefFailure(MappingError):
    def __init__(self, ref: str, reason: str):
        super().__init__(f'could not resolve $ref "{ref}": {reason}')


def merged(schema: Schema) -> Schema:
    """A schema itself, or if it has allOf, the merge of its branches without its other keywords."""
    if schema.all_of is None:
        return schema
    if not schema.all_of:
        raise EmptyCombinator("allOf")
    for i, s in enumerate(schema.all_of):
        if s.type != "object" and not s.properties:
            raise NotObjectLike(i)
    out = Schema()
    for s in schema.all_of:
        out = _objects(out, s, "")
    return out.with_(type="object")


def _first(a, b):
    return b if a is None else a


def _objects(a: Schema, b: Schema, path: str) -> Schema:
    properties = dict(a.properties)
    for k, p in b.properties.items():
        at = f"{path}.{k}" if path else k
        properties[k] = _properties(properties[k], p, at) if k in properties else p
    blank = lambda x: not (x or "").strip()
    return a.with_(
        properties=MappingProxyType(dict(sorted(properties.items()))),
        required=tuple(dict.fromkeys((a.required or ()) + (b.required or ()))) or None,
        title=b.title if blank(a.title) else a.title,
        description=b.description if blank(a.description) else a.description,
        comment=_first(a.comment, b.comment),
        deprecated=_first(a.deprecated, b.deprecated),
        examples=_first(a.examples, b.examples),
    )


def _agree(a, b, key: str, what: str):
    """The one that is present; a Conflict if both are and differ."""
    if a is None or b is None:
        return _first(a, b)
    if canonical(list(a) if isinstance(a, tuple) else a) != canonical(list(b) if isinstance(b, tuple) else b):
        raise Conflict(key, what)
    return a


def _properties(a: Schema, b: Schema, key: str) -> Schema:
    if a.is_object_with_properties and b.is_object_with_properties:
        return _objects(a, b, key)
    if a.is_array_with_items and b.is_array_with_items:
        return a.with_(items=_properties(a.items, b.items, f"{key}[]"))
    if a.type != b.type:
        raise Conflict(key, "types")
    if a.is_string:
        return a.with_(
            min_length=_first(a.min_length, b.min_length),
            max_length=_first(a.max_length, b.max_length),
            pattern=_agree(a.pattern, b.pattern, key, "pattern"),
            format=_first(a.format, b.format),
            enum=_agree(a.enum, b.enum, key, "enum values"),
            const=_agree(a.const, b.const, key, "const values"),
        )
    if a.is_integer or a.is_number:
        low = max((x for x in (a.minimum, b.minimum) if x is not None), default=None)
        high = min((x for x in (a.maximum, b.maximum) if x is not None), default=None)
        if low is not None and high is not None and low > high:
            raise Conflict(key, "minimum/maximum")
        return a.with_(minimum=low, maximum=high)
    if a.is_string_enum and b.is_string_enum:
        return a.with_(enum=_agree(a.enum, b.enum, key, "enum values"))
    if a.type is not None:
        raise Conflict(key, "types")
    return a
