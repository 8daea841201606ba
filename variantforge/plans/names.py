"""Names: field, type, variant, module and path names from arbitrary text (driver side)."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import PurePosixPath

#: Words that a field name may not be; they get a trailing underscore.
RESERVED = frozenset(
    (
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self "
        "static struct super trait true type unsafe use where while abstract become box do final gen macro override priv try typeof unsized virtual yield"
    ).split()
)


def ascii_only(s: str) -> str:
    return re.sub(r"[^\x00-\x7f]", "_", s)


def words(s: str) -> list[str]:
    """Words between other characters than letters and digits, and at changes of case; digits belong to the case before them."""
    s = re.sub(r"([a-z][0-9]*)(?=[A-Z])", r"\1_", s)
    s = re.sub(r"([A-Z][0-9]*)(?=[A-Z][a-z])", r"\1_", s)
    return [w for w in re.split(r"[^A-Za-z0-9]+", s) if w]


def field_name(key: str) -> str:
    s = ascii_only(key).replace("-", "_")
    if not s:
        return "empty"
    if s[0].isdigit():
        return f"field_{s}"
    s = re.sub(r"[^A-Za-z0-9_]", "_", s)
    if s == "_":
        return "empty"
    s = "_".join(words(s)).lower()
    return s + "_" if s in RESERVED else s


def pascal_case(name: str) -> str:
    s = "".join(w[0].upper() + w[1:].lower() for w in words(ascii_only(name)))
    if not s:
        return "Unnamed"
    return f"N{s}" if s[0].isdigit() else s


def type_name(s: str) -> str:
    pascal = pascal_case(s)
    return "Self_" if pascal == "Self" else pascal


def variant_name(value: str) -> str:
    s = re.sub(r"[^A-Za-z0-9 -]+", "_", ascii_only(value)).strip("_")
    if not s:
        return "EUnnamed"
    pascal = pascal_case(s)
    if s[0].isdigit():
        return "E" + pascal.removeprefix("N")
    return "ESelf" if pascal == "Self" else pascal


def variant_names(values: list[str]) -> list[tuple[str, str]]:
    """(value, name) in order; names that collide all get their index among the colliding."""
    bases = [variant_name(v) for v in values]
    total, seen, out = Counter(bases), {}, []
    for v, base in zip(values, bases, strict=True):
        group = seen.setdefault(base, [])
        group.append(v)
        out.append((v, base if total[base] == 1 else f"{base}{group.index(v)}"))
    return out


def path_component(s: str) -> str:
    s = re.sub(r"[^A-Za-z0-9_]", "_", s)
    if not s:
        return "schema"
    return f"_{s}" if s[0].isdigit() else s


def output_path(relative: str, suffix: str = ".rs") -> str:
    """A relative path with every component made safe; the last one's extension becomes suffix."""
    parts = [p for p in PurePosixPath(relative).parts if p not in ("/", ".")]
    if not parts:
        return ""
    return "/".join([*map(path_component, parts[:-1]), path_component(PurePosixPath(parts[-1]).stem) + suffix])


def module_name(s: str) -> str:
    s = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"[-. ]", "_", ascii_only(s)))
    if not s:
        return "schema"
    if s[0].isdigit():
        return f"schema_{s}"
    return f"{s}_mod" if s in ("crate", "self", "super") else s


def module_of_path(path: str) -> str:
    return module_name(PurePosixPath(path).stem or "schema")
