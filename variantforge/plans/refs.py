"""References inside one schema document: `#`, `#/$defs/<name>` and `#/definitions/<name>`."""

from __future__ import annotations

import json
from dataclasses import dataclass

from .pointer import InvalidEscape, decode_token
from .schema import Schema


class RefError(ValueError):
    """A reference that does not resolve; `reason` names the kind and its fields."""

    def __init__(self, kind: str, ref: str, name: str | None = None):
        quoted = ", ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in (("ref_str", ref), ("name", name)) if v is not None)
        self.kind, self.ref, self.name = kind, ref, name
        self.reason = f"{kind} {{ {quoted} }}"
        super().__init__(self.reason)


@dataclass(frozen=True)
class Target:
    """Where a reference points: the root (no container) or an entry of a container."""

    container: str | None = None
    name: str | None = None


_CONTAINERS = {"$defs": ("defs", "DefsMissing", "DefNotFound"), "definitions": ("definitions", "DefinitionsMissing", "DefinitionNotFound")}


def parse_ref(ref: str) -> Target:
    if ref in ("", "#"):
        return Target()
    if not ref.startswith("#"):
        raise RefError("UnsupportedRef", ref)
    steps = ref[1:].split("/")
    if len(steps) != 3 or steps[0] or not steps[1] or not steps[2]:
        raise RefError("UnsupportedFragment", ref)
    try:
        name = decode_token(steps[2])
    except InvalidEscape:
        raise RefError("InvalidPointerEscape", ref) from None
    if steps[1] not in _CONTAINERS:
        raise RefError("UnsupportedFragment", ref)
    return Target(steps[1], name)


def resolve(root: Schema, ref: str) -> Schema:
    """One step, looked up in the root's containers."""
    target = parse_ref(ref)
    if target.container is None:
        return root
    attribute, no_container, no_entry = _CONTAINERS[target.container]
    entries = getattr(root, attribute)
    if entries is None:
        raise RefError(no_container, ref)
    if target.name not in entries:
        raise RefError(no_entry, ref, target.name)
    return entries[target.name]


def follow(root: Schema, schema: Schema) -> Schema:
    """The schema that a chain of references ends at; siblings of `$ref` do not count."""
    seen: set[str] = set()
    while schema.ref is not None:
        if schema.ref in seen:
            raise RefError("RefCycle", schema.ref)
        seen.add(schema.ref)
        schema = resolve(root, schema.ref)
    return schema
