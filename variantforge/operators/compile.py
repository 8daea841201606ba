"""The compiled tier: a schema as a Column of errors over a VARIANT, with no Python per row.

Every value that a schema names outside arrays becomes a column of its own, level by level, with what checks
need of it (the text of its type, its number, its text): each is evaluated once a row, however many checks
read it.  What Catalyst cannot express with the same meaning raises ``NotCompilable``: recursive references,
nested const and enum values, uniqueItems over other than scalars, patterns without a translation, and very
large schemas.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.errors import ERROR_FIELDS, ERROR_TYPE, MESSAGES
from ..plans.patterns import java_pattern
from ..plans.pointer import encode_token
from ..plans.refs import RefError, follow
from ..plans.schema import Extra, Schema
from ..plans.values import canonical
from .interpret import ValidationOptions, check_terminates

#: Nodes beyond which a schema goes to the interpreter.
MAX_NODES = 200
_TYPES = {f.name: f.dataType for f in ERROR_TYPE}
_ARRAY = T.ArrayType(ERROR_TYPE)
_SCALARS = ("string", "integer", "number", "boolean")


class NotCompilable(ValueError):
    """Left to the interpreter."""


def _none() -> Column:
    return F.array().cast(_ARRAY)


class Stages:
    """Columns that are put beside a table before the errors; those of a level read only columns of lower levels."""

    def __init__(self, prefix: str):
        self.prefix, self.levels, self.known = prefix, [], {}

    def put(self, level: int, key: tuple, make) -> str:
        """The name of the column for a key, made by make() if new."""
        if key not in self.known:
            self.known[key] = f"{self.prefix}{len(self.known)}"
            while len(self.levels) < level:
                self.levels.append({})
            self.levels[level - 1][self.known[key]] = make()
        return self.known[key]


class Value:
    """A variant in an expression. Staged ones have a level and a name; others, in lambdas, are expressions."""

    def __init__(self, col: Column, kind: Column | None = None, stages: Stages | None = None, level: int = 0, name: str = ""):
        self.col, self._kind, self.stages, self.level, self.name = col, kind, stages, level, name

    def _part(self, what: str, make) -> Column:
        if self.stages is None:
            return make()
        return F.col(self.stages.put(self.level + 1, (self.name, what), make))

    @property
    def kind(self) -> Column:
        """The text of the type, as schema_of_variant gives it."""
        if self._kind is None:
            self._kind = self._part("kind", lambda: F.schema_of_variant(self.col))
        return self._kind

    @property
    def number(self) -> Column:
        return self._part("number", lambda: F.try_variant_get(self.col, "$", "double"))

    @property
    def text(self) -> Column:
        return self._part("text", lambda: F.try_variant_get(self.col, "$", "string"))

    @property
    def items(self) -> Column:
        return self._part("items", lambda: self.col.try_cast("array<variant>"))

    @property
    def entries(self) -> Column:
        return self._part("entries", lambda: self.col.try_cast("map<string,variant>"))

    def member(self, key: str) -> Value:
        if self.stages is None:
            return Value(member(self.col, key))
        name = self.stages.put(self.level + 1, (self.name, "member", key), lambda: member(self.col, key))
        return Value(F.col(name), None, self.stages, self.level + 1, name)


def canonical_text(v: Value) -> Column:
    """Canonical JSON: exact for scalars; nested numbers as Spark writes them."""
    x, kind = v.number, v.kind
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
    exponent = F.replace(F.replace(x.cast("string"), F.lit("E"), F.lit("e")), F.lit(".0e"), F.lit("e"))
    real = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return F.when(real & (F.abs(x) >= 1e-5) & (F.abs(x) < 1e16), plain).when(real, exponent).otherwise(F.to_json(v.col))


def kind_name(kind: Column) -> Column:
    """The JSON type name of a variant, from the text of its type."""
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")


def encoded(k: Column) -> Column:
    return F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def number_text(x: Column) -> Column:
    """A double without exponent and without an empty fraction, whatever its size."""
    text = F.abs(x).cast("string")
    exponent = F.coalesce(F.try_element_at(F.split(text, "E"), F.lit(2)).cast("int"), F.lit(0))
    mantissa = F.element_at(F.split(text, "E"), 1)
    whole, part = F.element_at(F.split(mantissa, r"\."), 1), F.element_at(F.split(mantissa, r"\."), 2)
    digits, point = F.concat(whole, part), F.length(whole) + exponent
    far = F.greatest(point, F.length(digits))
    right = F.concat(F.substr(F.rpad(digits, far, "0"), F.lit(1), point), F.lit("."), F.substr(F.rpad(digits, far, "0"), point + 1, far))
    left = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    plain = F.when(exponent == 0, mantissa).when(point > 0, right).otherwise(left)
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.concat(F.when((x < 0) | x.cast("string").startswith("-"), "-").otherwise(""), trimmed)


def error_column(kind: str, path: Column, **payload) -> Column:
    """One error struct; payload values are Columns or literals."""
    fields = {"kind": F.lit(kind), "path": path}
    for name, value in payload.items():
        fields[name] = value if isinstance(value, Column) else F.array(*[F.lit(x) for x in value]) if name == "allowed" else F.lit(value)
    return F.struct(*[fields[n].cast(_TYPES[n]).alias(n) if n in fields else F.lit(None).cast(_TYPES[n]).alias(n) for n in ERROR_FIELDS])


def message(e) -> Column:
    """The message of an error: e["kind"], e["path"] and so on are its fields."""
    loc = F.when(e["path"] == "", "root").otherwise(e["path"])
    out = None
    for kind, template in MESSAGES.items():
        parts = [loc, F.lit(": ")]
        for i, p in enumerate(re.split(r"\{(\w+)\}", template)):
            if i % 2:
                parts.append(F.array_join(e[p], ", ") if p == "allowed" else number_text(e[p]) if p.startswith("d_") else e[p].cast("string"))
            elif p:
                parts.append(F.lit(p))
        out = (F if out is None else out).when(e["kind"] == kind, F.concat(*parts))
    return out


def with_messages(errors: Column) -> Column:
    """An array of errors, each with its message."""
    return F.transform(errors, lambda e: F.struct(*[e[n].alias(n) for n in ERROR_FIELDS], message(e).alias("message")))


def _if(condition: Column, kind: str, path: Column, **payload) -> Column:
    return F.when(condition, F.array(error_column(kind, path, **payload))).otherwise(_none())


def same_value(v: Value, x) -> Column:
    """Whether a variant equals a JSON scalar, numbers typed."""
    kind = v.kind
    if x is None:
        return kind == "VOID"
    if isinstance(x, bool):
        return F.when(kind == "BOOLEAN", v.text == ("true" if x else "false")).otherwise(False)
    if isinstance(x, str):
        return F.when(kind == "STRING", v.text == x).otherwise(False)
    if isinstance(x, int):
        if not -(1 << 63) <= x < 1 << 63:
            raise NotCompilable("an integer beyond 64 bits")
        return F.when(kind == "BIGINT", v.text == str(x)).otherwise(False)
    if isinstance(x, float):
        return F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), v.number == x).otherwise(False)
    raise NotCompilable("const or enum holds an object or array")


def member(v: Column, key: str) -> Column:
    """The value of a key of an object variant; SQL null only if the key is missing or the variant is no object."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key):
        return F.variant_get(v, f"$.{key}", "variant")
    return F.try_element_at(v.try_cast("map<string,variant>"), F.lit(key))


class _Compiler:
    def __init__(self, root: Schema, options: ValidationOptions):
        self.root, self.options, self.nodes = root, options, 0

    def errors(self, node: Schema, v: Value, path: Column, above: tuple[str, ...] = ()) -> Column:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise NotCompilable(f"over {MAX_NODES} nodes")
        if node.ref is not None:
            ref = node.ref
            if ref in above:
                raise NotCompilable("recursive reference")
            try:
                node = follow(self.root, node)
            except RefError as e:
                return F.array(error_column("InvalidRef", path, property=ref, expected=e.reason))
            above = (*above, ref)
        elif len(above) > 64:
            raise NotCompilable("deep nesting")
        go = lambda sub, value=v, at=path: self.errors(sub, value, at, above)
        if node.any_of is not None or node.one_of is not None:
            rest = self._branches(node, path, go)
        elif node.all_of:
            rest = F.concat(*[go(sub) for sub in node.all_of])
        else:
            rest = getattr(self, f"_{node.type}", self._untyped)(node, v, path, go)
        if node.enum:
            texts = [canonical(x) for x in node.enum]
            strings = [x for x in node.enum if isinstance(x, str)]
            found = F.when(v.kind == "STRING", v.text.isin(*strings)).otherwise(False) if strings else F.lit(False)
            for x in node.enum:
                if not isinstance(x, str):
                    found = found | same_value(v, x)
            rest = F.when(~found, F.array(error_column("NotInEnum", path, actual=canonical_text(v), allowed=texts))).otherwise(rest)
        if node.const is not None:
            rest = F.when(~same_value(v, node.const), F.array(error_column("NotConst", path, expected=canonical(node.const), actual=canonical_text(v)))).otherwise(rest)
        return rest

    def _branches(self, node, path, go):
        branches = node.any_of if node.any_of is not None else node.one_of
        n = len(branches)
        none = F.array(error_column("NoSubschemaMatched", path, n_expected=n))
        if not n:
            return none
        passes = [F.size(go(sub)) == 0 for sub in branches]
        if node.any_of is not None:
            good = passes[0]
            for p in passes[1:]:
                good = good | p
            return F.when(good, _none()).otherwise(none)
        count = F.lit(0)
        for p in passes:
            count = count + p.cast("int")
        many = lambda c: F.array(error_column("MultipleSubschemasMatched", path, n_expected=n, n_actual=c))
        return F.get(F.transform(F.array(count), lambda c: F.when(c == 0, none).when(c > 1, many(c)).otherwise(_none())), F.lit(0))

    def _members(self, node, v, path, go):
        parts = [_if(v.member(k).col.isNull(), "MissingRequired", F.concat(path, F.lit("/" + encode_token(k))), property=k) for k in node.required or ()]
        deep = []
        for k, sub in node.properties.items():
            value = v.member(k)
            deep.append(F.when(value.col.isNotNull(), go(sub, value, F.concat(path, F.lit("/" + encode_token(k))))).otherwise(_none()))
        return parts, deep

    def _object(self, node, v, path, go):
        missing, deep = self._members(node, v, path, go)
        middle = []
        extra = node.additional_properties
        if isinstance(extra, Schema) or extra is Extra.FORBID:
            known = F.array(*[F.lit(k) for k in node.properties]).cast("array<string>")
            entries = v.entries
            others = F.array_sort(F.array_except(F.map_keys(entries), known))
            at = lambda k: F.concat(path, F.lit("/"), encoded(k))
            if extra is Extra.FORBID:
                middle.append(F.transform(others, lambda k: error_column("DisallowedAdditionalProperty", at(k), property=k)))
            else:
                found = F.transform(F.reverse(others), lambda k: F.struct(k.alias("k"), F.element_at(entries, k).alias("v")))
                typed = F.transform(found, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), F.schema_of_variant(e["v"]).alias("t")))
                middle.append(F.flatten(F.transform(typed, lambda e: go(extra, Value(e["v"], e["t"]), at(e["k"])))))
        parts = [*missing, *middle, *deep]
        return self._typed(v, "OBJECT", "ExpectedObject", path, F.concat(*parts) if parts else _none())

    def _typed(self, v, prefix, kind, path, rest):
        return F.when(v.kind.startswith(prefix), rest).otherwise(F.array(error_column(kind, path, actual=kind_name(v.kind))))

    def _untyped(self, node, v, path, go):
        missing, deep = self._members(node, v, path, go)
        parts = [*missing, *deep]
        return F.when(v.kind.startswith("OBJECT"), F.concat(*parts)).otherwise(_none()) if parts else _none()

    def _string(self, node, v, path, go):
        text = v.text
        parts = []
        if node.min_length is not None or node.max_length is not None:
            n = F.char_length(text)
            if node.min_length is not None:
                parts.append(_if(n < node.min_length, "TooShort", path, n_expected=node.min_length, n_actual=n))
            if node.max_length is not None:
                parts.append(_if(n > node.max_length, "TooLong", path, n_expected=node.max_length, n_actual=n))
        if node.pattern is not None:
            try:
                pattern = java_pattern(node.pattern)
            except re.error:
                parts.append(F.array(error_column("InvalidPatternInSchema", path, property=node.pattern)))
            else:
                if pattern is None:
                    raise NotCompilable("a pattern without translation")
                parts.append(_if(~text.rlike(pattern), "PatternMismatch", path, property=node.pattern, actual=text))
        if self.options.enable_uuid and node.format == "uuid":
            plain = "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
            parts.append(_if(~text.rlike(rf"(?i)\A(?:[0-9a-f]{{32}}|(?:urn:uuid:)?{plain}|\{{{plain}\}})\z"), "InvalidUuidFormat", path, actual=text))
        return self._typed(v, "STRING", "ExpectedString", path, _all(parts))

    def _bounds(self, node, v, path):
        parts = []
        if node.minimum is not None:
            parts.append(_if(v.number < node.minimum, "BelowMinimum", path, d_expected=node.minimum, d_actual=v.number))
        if node.maximum is not None:
            parts.append(_if(v.number > node.maximum, "AboveMaximum", path, d_expected=node.maximum, d_actual=v.number))
        return _all(parts)

    def _integer(self, node, v, path, go):
        return self._typed(v, "BIGINT", "ExpectedInteger", path, self._bounds(node, v, path))

    def _number(self, node, v, path, go):
        good = v.kind.isin("BIGINT", "DOUBLE", "FLOAT") | v.kind.startswith("DECIMAL")
        return F.when(good, self._bounds(node, v, path)).otherwise(F.array(error_column("ExpectedNumber", path, actual=kind_name(v.kind))))

    def _array(self, node, v, path, go):
        values = v.items
        n = F.size(values)
        parts = []
        if node.min_items is not None:
            parts.append(_if(n < node.min_items, "TooFewItems", path, n_expected=node.min_items, n_actual=n))
        if node.max_items is not None:
            parts.append(_if(n > node.max_items, "TooManyItems", path, n_expected=node.max_items, n_actual=n))
        typed = F.transform(values, lambda e: F.struct(e.alias("v"), F.schema_of_variant(e).alias("t")))
        if node.unique_items:
            if node.items is None or node.items.type not in _SCALARS:
                raise NotCompilable("uniqueItems over other than scalars")
            texts = F.transform(typed, lambda e: canonical_text(Value(e["v"], e["t"])))
            twice = lambda t: F.get(F.filter(t, lambda x, i: F.array_contains(F.slice(t, i + 2, F.size(t)), x)), F.lit(0))
            check = lambda t: _if(F.size(F.array_distinct(t)) < F.size(t), "DuplicateArrayItems", path, actual=twice(t))
            parts.append(F.get(F.transform(F.array(texts), check), F.lit(0)))
        if node.items is not None:
            parts.append(F.flatten(F.transform(typed, lambda e, i: go(node.items, Value(e["v"], e["t"]), F.concat(path, F.lit("/"), i.cast("string"))))))
        if not parts:
            return self._typed(v, "ARRAY", "ExpectedArray", path, _none())
        return F.when(values.isNotNull(), _all(parts)).otherwise(F.array(error_column("ExpectedArray", path, actual=kind_name(v.kind))))

    def _boolean(self, node, v, path, go):
        return self._typed(v, "BOOLEAN", "ExpectedBoolean", path, _none())


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def compile_errors(schema: Schema, v: Column, options: ValidationOptions = ValidationOptions()) -> Column:
    """The errors of a VARIANT column as one expression, in ``validate``'s order; SQL null gives none. Raises NotCompilable."""
    check_terminates(schema)
    return F.when(v.isNull(), _none()).otherwise(_Compiler(schema, options).errors(schema, Value(v), F.lit("")))


def staged_errors(schema: Schema, root: str, kind: str, prefix: str, options: ValidationOptions = ValidationOptions()) -> tuple[list[dict[str, Column]], Column]:
    """The same, for a column `root` with the text of its type in `kind`: (columns to add, level by level; the errors over them)."""
    check_terminates(schema)
    stages = Stages(prefix)
    found = _Compiler(schema, options).errors(schema, Value(F.col(root), F.col(kind), stages, 0, root), F.lit(""))
    return stages.levels, F.when(F.col(root).isNull(), _none()).otherwise(found)
