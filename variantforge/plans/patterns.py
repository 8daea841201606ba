"""ECMA-262 patterns for Python's and Java's engines: translated where the meaning is the same, else refused."""

from __future__ import annotations

import re

#: What `\\s` matches in ECMA-262, inside a class.
_SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_LINE_END = "\\n\\r\\u2028\\u2029"


class Untranslatable(ValueError):
    """Valid perhaps, but not expressible with the same meaning."""


def translate(pattern: str, java: bool = False) -> str:
    """The pattern for Java (java=True) or Python, unanchored search. Raises re.error if invalid, Untranslatable if unsure."""
    out, i, in_class, first = [], 0, False, False
    n = len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            if i + 1 == n:
                raise re.error("trailing backslash", pattern)
            e = pattern[i + 1]
            i += 2
            if e in "dD":
                out.append(("[^0-9]" if e == "D" else "[0-9]") if not in_class else "0-9" if e == "d" else _no())
            elif e in "wW":
                out.append(("[^A-Za-z0-9_]" if e == "W" else "[A-Za-z0-9_]") if not in_class else "A-Za-z0-9_" if e == "w" else _no())
            elif e in "sS":
                out.append((f"[^{_SPACE}]" if e == "S" else f"[{_SPACE}]") if not in_class else _SPACE if e == "s" else _no())
            elif e in "nrtf":
                out.append("\\" + e)
            elif e == "v":
                out.append("\\x0b")
            elif e in "bB" and not in_class:
                _no()  # word boundaries differ on letters outside ASCII
            elif e == "b":
                out.append("\\x08")
            elif e == "0" and not pattern[i : i + 1].isdigit():
                out.append("\\x00")
            elif e == "x" and re.match("[0-9a-fA-F]{2}", pattern[i:]):
                out.append("\\x" + pattern[i : i + 2])
                i += 2
            elif e == "u" and re.match("[0-9a-fA-F]{4}", pattern[i:]) and not 0xD800 <= int(pattern[i : i + 4], 16) < 0xE000:
                out.append("\\u" + pattern[i : i + 4])
                i += 4
            elif e == "c" and re.match("[A-Za-z]", pattern[i:]):
                out.append(f"\\x{ord(pattern[i]) % 32:02x}")
                i += 1
            elif e.isalnum():
                _no()
            else:
                out.append(re.escape(e) if not java or e.isascii() else e)
            first = False
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append("]")
            elif c in "[&~|-" and c != "-" or c == "^" and not first:
                out.append("\\" + c)
            else:
                out.append(c)
            first = False
            i += 1
            continue
        if c == "[":
            if pattern.startswith("[^]", i):
                out.append("[\\x00-\\U0010ffff]" if not java else "[\\x{0}-\\x{10FFFF}]")
                i += 3
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            in_class, first = True, True
            out.append("[")
            if pattern.startswith("[^", i):
                out.append("^")
                i += 1
        elif c == ".":
            out.append(f"[^{_LINE_END}]")
        elif c == "$":
            out.append("\\z" if java else "\\Z")
        elif c == "(" and pattern.startswith("(?", i):
            m = re.match(r"\(\?(?::|=|!|<=|<!|<[A-Za-z_]\w*>)", pattern[i:])
            if not m:
                raise re.error("unknown group", pattern)
            named = m.group()[2] == "<" and m.group()[3] not in "=!"
            out.append(("(?P" + m.group()[2:] if not java else m.group()) if named else m.group())
            i += len(m.group())
            continue
        elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise re.error("nothing to repeat", pattern)
        elif c == "{" and not re.match(r"\{\d+(?:,\d*)?\}", pattern[i:]):
            out.append("\\{")
        elif c == "}" and not re.search(r"\{\d+(?:,\d*)?$", pattern[:i]):
            out.append("\\}")
        elif c == "]":
            out.append("\\]")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise re.error("unterminated class", pattern)
    text = "".join(out)
    check = text.replace("\\z", "\\Z").replace("[\\x{0}-\\x{10FFFF}]", "[\\x00-\\U0010ffff]")
    re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", check) if java else text)
    return text


def _no():
    raise Untranslatable("no translation with the same meaning")


def compile_pattern(pattern: str) -> re.Pattern | None:
    """A Python pattern with the ECMA meaning; None if the pattern is invalid.

    Word boundaries, back references and property classes, which ``translate`` refuses, are compiled as
    Python has them, boundaries over ASCII words.
    """
    try:
        return re.compile(translate(pattern))
    except Untranslatable:
        try:
            return re.compile(re.sub(r"\$(?!\])", r"\\Z", pattern), re.ASCII)
        except re.error:
            return None
    except re.error:
        return None


def java_pattern(pattern: str) -> str | None:
    """The pattern for rlike, None if it must be left to Python. Raises re.error if invalid."""
    try:
        return translate(pattern, java=True)
    except Untranslatable:
        return None
