"""JSON values on the driver and in Python workers: strict parsing, typed equality, canonical text.

Values are None, bool, int, float, str, list and dict; an int and a float never equal each other, and a
number is an int only if it was written without fraction or exponent and fits 64 bits.
"""

from __future__ import annotations

import json
from decimal import Decimal

#: Values nest at most so deep in parsed text.
MAX_DEPTH = 128
_I64, _U64 = 1 << 63, 1 << 64


class InvalidJson(ValueError):
    pass


def _integer(text: str):
    x = int(text)
    if text.startswith("-") and x == 0:
        return -0.0
    return x if -_I64 <= x < _U64 else _real(text)


def _real(text: str) -> float:
    x = float(text)
    if x in (float("inf"), float("-inf")):
        raise InvalidJson("number out of range")
    return x


def _constant(text: str):
    raise InvalidJson(f"{text} is not JSON")


def _depth(value) -> int:
    deepest, stack = 0, [(value, 1)]
    while stack:
        v, d = stack.pop()
        if isinstance(v, (dict, list)):
            deepest = max(deepest, d)
            stack.extend((x, d + 1) for x in (v.values() if isinstance(v, dict) else v))
    return deepest


def parse_json(text: str, max_depth: int | None = MAX_DEPTH):
    """The value of one JSON text; the last of duplicate keys wins. InvalidJson for anything else."""
    try:
        value = json.loads(text, parse_int=_integer, parse_float=_real, parse_constant=_constant)
        if "\\u" in text:
            json.dumps(value, ensure_ascii=False).encode()
    except (ValueError, RecursionError, UnicodeEncodeError) as e:
        raise e if isinstance(e, InvalidJson) else InvalidJson(str(e)) from e
    if max_depth is not None and text.count("[") + text.count("{") > max_depth and _depth(value) > max_depth:
        raise InvalidJson("nesting is too deep")
    return value


def kind(value) -> str:
    """The JSON type name; both sorts of number are `number`."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def is_integer(value) -> bool:
    """A signed 64-bit integer, written as one."""
    return type(value) is int and -_I64 <= value < _I64


def is_number(value) -> bool:
    return type(value) in (int, float)


def equal(a, b) -> bool:
    """Equality with typed numbers; the order of object keys does not count."""
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return a == b


def real_text(x: float) -> str:
    """Shortest decimal digits that read back as x: plain from 1e-5 up to under 1e16, else with an exponent."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    exponent += len(digits) - len(text)
    if x == 0:
        return "-0.0" if sign else "0.0"
    point = len(text) + exponent
    if exponent >= 0 and point <= 16:
        body = text + "0" * exponent + ".0"
    elif 0 < point <= 16:
        body = f"{text[:point]}.{text[point:]}"
    elif -5 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = f"{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{point - 1}"
    return "-" * sign + body


def plain_number(x: float) -> str:
    """x as a decimal number without exponent, and without a fraction if it has none."""
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def canonical(value) -> str:
    """Compact JSON with sorted keys; equal texts mean equal values."""
    if isinstance(value, float):
        return real_text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value, ensure_ascii=False)
