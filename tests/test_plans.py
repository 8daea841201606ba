"""Schemas, references, pointers, names, merging, type mapping, deduplication and reverse mapping."""

import io
import json
import random
from enum import Enum

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variantforge.functions import names as column_names
from variantforge.functions import pointer as column_pointer
from variantforge.plans import names, reverse
from variantforge.plans.dedupe import DedupeMode, dedupe_key
from variantforge.plans.merge import BatchError, Conflict, EmptyCombinator, NotObjectLike, RootNotObject, merged
from variantforge.plans.models import DdlBackend, JsonBackend, Mapper, MappingSettings, NameSource, StructTypeBackend, ddl_of, generate, in_order, struct_type, struct_types
from variantforge.plans.pointer import InvalidEscape, InvalidUtf8, JsonPointer
from variantforge.plans.refs import RefError, Target, parse_ref
from variantforge.plans.reverse import UnsupportedType, hoist_defs, register_type, schema_for, schema_from_struct, schema_of_enum
from variantforge.plans.schema import Extra, Schema, SchemaIoError, SchemaParseError, SchemaSettings, SpecVersion, UnknownField

STRICT = SchemaSettings(disallow_unknown_fields=True)
STR = {"type": "string"}


def obj(p, **more):
    return {"type": "object", "properties": p, **more}


def test_sources_agree(tmp_path):
    text = '{"type":"object","required":["a"]}'
    path = tmp_path / "s.json"
    path.write_text(text)
    want = Schema(type="object", required=("a",))
    for source in (text, text.encode(), json.loads(text), io.StringIO(text), io.BytesIO(text.encode()), path, want):
        assert Schema.of(source) == want
    with pytest.raises(SchemaIoError):
        Schema.of(tmp_path / "gone.json")
    for bad in ("{", b"\xff", "[]", "true", {"minLength": -1}, {"minLength": 1.5}, {"required": True}, {"properties": {"a": True}}, {"additionalProperties": 1}, {"properties": None}):
        with pytest.raises(SchemaParseError):
            Schema.of(bad)


def test_strict_and_lenient():
    for bad in ({"unknown": 1}, obj({"n": {"bad": 1}}), {"$defs": {"A": {"bad": 1}}}, {"allOf": [{"bad": 1}]}):
        assert isinstance(Schema.of(bad), Schema)
        with pytest.raises(UnknownField):
            Schema.of(bad, STRICT)
    assert Schema.of({"additionalProperties": {"bad": 1}}, STRICT).additional_properties == Schema()


def test_round_trip_and_order():
    s = {"$id": "x", "type": "object", "$defs": {"B": {}, "A": STR}, "properties": {"b": STR, "a": {"minimum": 1.5}}, "additionalProperties": True, "required": ["b"], "enum": [1, None], "oneOf": [{}]}
    again = Schema.of(s)
    assert Schema.of(again.to_json()) == again
    assert list(json.loads(again.to_json())) == ["$id", "type", "$defs", "properties", "additionalProperties", "required", "enum", "oneOf"]
    assert Schema.of({"required": [], "enum": [], "allOf": [], "properties": {}}).to_json() == "{}"
    assert Schema.of({"type": [], "default": None, "const": None}) == Schema()
    assert again.additional_properties is Extra.ALLOW


def test_spec_versions():
    for v in SpecVersion:
        assert SpecVersion.from_schema_uri(f" {v.schema_uri} ") is v
    assert SpecVersion.from_schema_uri("http://json-schema.org/schema#") is SpecVersion.DRAFT_04
    assert SpecVersion.from_schema_uri("") is None and SpecVersion.from_schema_uri("x") is None
    assert SchemaSettings().resolved_spec_version(Schema(schema=SpecVersion.DRAFT_06.value)) is SpecVersion.DRAFT_06
    assert SchemaSettings(spec_version=SpecVersion.DRAFT_07).resolved_spec_version(Schema()) is SpecVersion.DRAFT_07
    assert SchemaSettings().resolved_spec_version() is SpecVersion.DRAFT_2020_12


def test_refs():
    assert parse_ref("") == parse_ref("#") == Target()
    assert parse_ref("#/$defs/a~1b~0") == Target("$defs", "a/b~")
    for ref, kind in (("x", "UnsupportedRef"), ("#a", "UnsupportedFragment"), ("#/$defs/A/B", "UnsupportedFragment"), ("#/$defs/", "UnsupportedFragment"), ("#/$defs/~2", "InvalidPointerEscape"), ("#/o/A", "UnsupportedFragment")):
        with pytest.raises(RefError) as e:
            parse_ref(ref)
        assert e.value.kind == kind


def test_pointers(spark):
    p = JsonPointer().push("a/b").push("~").push("")
    assert str(p) == "/a~1b/~0/" and JsonPointer.parse(str(p)) == p and len(p) == 3 and JsonPointer.parse(str(p).encode()) == p
    assert str(p.pop()) == "/a~1b/~0" and str(p.truncate(1)) == "/a~1b" and str(p.remove(1)) == "/a~1b/" and p.remove(9) == p
    assert JsonPointer().display() == "root" and JsonPointer().pop().is_root and p.segment_at(0) == "a/b" and p.segment_at(7) is None
    for bad in ("a", "/~", "/~2"):
        with pytest.raises(InvalidEscape):
            JsonPointer.parse(bad)
    with pytest.raises(InvalidUtf8):
        JsonPointer.parse(b"/\xff")
    r = random.Random(1)
    texts = ["".join(r.choice(["/", "~0", "~1", "a", "é"]) for _ in range(r.randrange(8))) for _ in range(50)]
    good = [t for t in texts if t == "" or t.startswith("/")]
    df = spark.createDataFrame([(t,) for t in good], "p string")
    c = F.col("p")
    for row in df.select("p", column_pointer.segments(c).alias("s"), column_pointer.pop(c).alias("pop"), column_pointer.truncate(c, 1).alias("t"), column_pointer.remove(c, 1).alias("r"), column_pointer.length(c).alias("n")).collect():
        q = JsonPointer.parse(row["p"])
        assert (tuple(row["s"]), row["pop"], row["t"], row["r"], row["n"]) == (q.segments, str(q.pop()), str(q.truncate(1)), str(q.remove(1)), len(q)), row


NAMES = ["deck-plan", "seaLevel", "GPSTrack", "47", "self", "/310", "port.side", "", "_", "2-x y", "loop", "naïf", "AB1Cd", "a1B", "Self", "__x", "x y-z", "URLPath2Id", "a b"]


def test_names(spark):
    assert [names.field_name(x) for x in ("deck-plan", "seaLevel", "GPSTrack", "2-x y", "", "_", "loop")] == ["deck_plan", "sea_level", "gps_track", "field_2_x y", "empty", "empty", "loop_"]
    assert [names.variant_name(x) for x in ("47", "self", "/310", "port.side", "deck-plan", "")] == ["E47", "ESelf", "E310", "PortSide", "DeckPlan", "EUnnamed"]
    assert names.variant_names(["a", "A"]) == [("a", "A0"), ("A", "A1")]
    assert names.type_name("self") == "Self_" and names.pascal_case("") == "Unnamed" and names.pascal_case("1a") == "N1a"
    assert names.path_component("") == "schema" and names.path_component("1-x") == "_1_x" and names.output_path("a b/c.json") == "a_b/c.rs"
    assert names.module_name("my-mod.x") == "my_mod_x" and names.module_name("crate") == "crate_mod" and names.module_name("9") == "schema_9" and names.module_of_path("a/b-c.json") == "b_c"
    df = spark.createDataFrame([(x,) for x in NAMES], "s string")
    s = F.col("s")
    both = {"field": names.field_name, "type": names.type_name, "variant": names.variant_name, "path": names.path_component, "module": names.module_name}
    cols = [column_names.field_name(s).alias("field"), column_names.type_name(s).alias("type"), column_names.variant_name(s).alias("variant"), column_names.path_component(s).alias("path"), column_names.module_name(s).alias("module")]
    for row in df.select("s", *cols).collect():
        assert {k: row[k] for k in both} == {k: f(row["s"]) for k, f in both.items()}, row["s"]


def test_merge():
    m = merged(Schema.of({"allOf": [obj({"a": STR}, title=" ", required=["a"]), obj({"a": {"type": "string", "minLength": 2}, "b": {"type": "integer", "minimum": 1}}, title="T", required=["b", "a"])], "description": "gone"}))
    assert m.type == "object" and m.required == ("a", "b") and m.title == "T" and m.description is None and m.properties["a"].min_length == 2
    both = lambda a, b: merged(Schema.of({"allOf": [obj({"x": a}), obj({"x": b})]}))
    assert (both({"type": "integer", "minimum": 1}, {"type": "integer", "minimum": 3, "maximum": 9}).properties["x"].minimum) == 3
    for a, b, what in ((STR, {"type": "integer"}, "types"), ({"type": "integer", "minimum": 5}, {"type": "integer", "maximum": 1}, "minimum/maximum"), (STR | {"enum": ["a"]}, STR | {"enum": ["b"]}, "enum values"), (STR | {"const": "a"}, STR | {"const": "b"}, "const values"), (STR | {"pattern": "a"}, STR | {"pattern": "b"}, "pattern")):
        with pytest.raises(Conflict) as e:
            both(a, b)
        assert e.value.what == what
    with pytest.raises(EmptyCombinator):
        merged(Schema.of({"allOf": []}))
    with pytest.raises(NotObjectLike):
        merged(Schema.of({"allOf": [STR]}))


def models(schema, **settings):
    return Mapper(Schema.of(schema), MappingSettings(**settings)).models()


def test_models():
    person = obj({"berth": obj({"deck": STR, "cabin_number": STR}), "crew": STR})
    found = models(person)
    assert [m.name for m in found] == ["Berth", "Root"] and [f.name for f in found[1].fields] == ["berth", "crew"]
    assert [(m.name, m.variants) for m in models(obj({"s": {"enum": ["a", "A"]}, "t": {"enum": ["A", "a"]}})) if m.kind == "enum"] == [("S", (("A", "A0"), ("a", "A1")))]
    assert [m.name for m in models({"oneOf": [obj({"a": STR}), obj({"b": STR})]}) if m.kind == "union"] == ["RootOneOf"]
    assert {m.name for m in models(obj({"load": {"anyOf": [STR, obj({"x": {"type": "integer"}})]}}))} == {"LoadAnyOf", "LoadVariant1", "Root"}
    titled = obj({"hold": obj({"c": STR}, title="CargoBay")})
    assert models(titled)[0].name == "CargoBay" and models(titled, name_source=NameSource.PROPERTY_KEY_FIRST)[0].name == "Hold"
    with pytest.raises(RootNotObject):
        models(STR)
    with pytest.raises(BatchError) as e:
        generate([person, {"allOf": []}])
    assert e.value.index == 1
    deep = obj({"v": STR})
    for i in range(60):
        deep = obj({f"c{i}": deep})
    assert len(models(deep)) == 61
    assert struct_type(obj({"c": {"$ref": "#"}}))["c"].dataType == T.VariantType()


def test_struct_types_and_backends():
    s = obj({"b": {"type": "integer", "minimum": 0, "maximum": 255}, "u": {"type": "integer", "minimum": 0, "maximum": 2**63}, "f": {"type": "number", "minimum": 0, "maximum": 1}, "t": {"type": "array", "items": STR, "uniqueItems": True}, "n": {"type": "null"}}, required=["b"], additionalProperties=STR)
    kind = struct_type(s)
    assert kind.simpleString() == "struct<b:smallint,f:float,n:variant,t:array<string>,u:decimal(20,0),additional:map<string,string>>"
    assert kind["t"].metadata["unique_items"] and kind["b"].metadata["required"]
    assert "b SMALLINT" in DdlBackend().generate([s])["schema_0"]
    text = StructTypeBackend().generate([s])["schema_0"]
    names_space: dict = {}
    exec(text, names_space)
    assert names_space["SCHEMA"] == kind and "LongType" not in text and "DecimalType" in text
    both = JsonBackend().generate([obj({"id": STR}), obj({"id": STR})])
    assert set(both) == {"shared", "schema_0", "schema_1"} and json.loads(both["schema_1"]) == {"export": "Root", "from": "shared"}


def test_dedupe():
    a, b = obj({"id": STR}), obj({"id": STR}, description="d")
    shared = [m.name for _, _, m, is_shared in generate([a, a]).rows if is_shared]
    assert shared == ["Root"] and not any(x[3] for x in generate([a, b]).rows)
    assert [x[3] for x in generate([a, b], MappingSettings(dedupe=DedupeMode.FUNCTIONAL)).rows] == [True]
    assert not any(x[3] for x in generate([a, a], MappingSettings(dedupe=DedupeMode.DISABLED)).rows)
    key = lambda s, **k: dedupe_key(Schema.of(s), **k)
    low, high = obj({"n": {"type": "integer", "minimum": 1}}), obj({"n": {"type": "integer", "minimum": 2}})
    assert key(low) == key(high) and key(low, strict=True) != key(high, strict=True)


def test_ddl_reads_back(spark):
    s = obj({"a b": STR | {"description": "it's a\n\"note\" \\\\ x"}, "n": obj({"l": {"type": "array", "items": {"type": "integer"}}}), "v": {}, "m": {"type": "object", "additionalProperties": {"type": "number"}}, "u": {"type": "integer", "minimum": 0, "maximum": 2**63}})
    kind = struct_type(s)
    again = T.StructType.fromDDL(ddl_of(kind))
    assert again.simpleString() == kind.simpleString() and again["a b"].metadata["comment"] == kind["a b"].metadata["comment"]


def test_shared_models_come_in_order_and_circles_are_cut():
    city = obj({"name": STR}, title="City")
    leg = obj({"from": city, "list": {"type": "array", "items": city}}, title="Leg")
    made = generate([obj({"z": leg}, title="A"), obj({"a": city, "b": leg}, title="B")])
    assert [m.name for m in made.shared] == ["City", "Leg"] and made.exports == (("City", "Leg"), ("City", "Leg"))
    assert [m.name for m in in_order(list(made.shared)[::-1])] == ["City", "Leg"]
    circle = obj({"next": {"$ref": "#"}}, title="Node")
    assert [m.name for m in generate([circle, circle]).shared] == ["Node"]
    same = generate([obj({"p": obj({"x": STR}, title="T")}), obj({"p": obj({"x": STR}, title="T")}), obj({"q": obj({"y": STR}, title="T")}), obj({"q": obj({"y": STR}, title="T")})])
    assert sorted(m.name for m in same.shared) == ["Root", "Root2", "T", "T2"]


def test_several_schemas_in_one_call(tmp_path):
    (tmp_path / "my-file.json").write_text(json.dumps(obj({"n": {"type": "integer"}})))
    found = struct_types(json.dumps(obj({"a": STR})), str(tmp_path / "my-file.json"), tmp_path / "my-file.json", obj({"b": STR}))
    assert [(k, v.simpleString()) for k, v in found.items()] == [("schema_0", "struct<a:string>"), ("my_file", "struct<n:bigint>"), ("my_file_2", "struct<n:bigint>"), ("schema_3", "struct<b:string>")]
    with pytest.raises(BatchError) as e:
        struct_types(json.dumps(obj({"a": STR})), '{"type": "string"}')
    assert e.value.index == 1
    with pytest.raises(SchemaIoError):
        struct_types(str(tmp_path / "gone.json"))


class Celsius(T.UserDefinedType):
    """A user's own type with a schema of its own."""

    @classmethod
    def sqlType(cls):
        return T.DoubleType()

    @classmethod
    def json_schema(cls):
        return Schema(type="number", minimum=-273.15)


class Plain(T.UserDefinedType):
    @classmethod
    def sqlType(cls):
        return T.ByteType()


def test_reverse_of_own_types():
    assert schema_for(Celsius()).minimum == -273.15 and schema_for(Plain()).maximum == 127
    register_type(T.BinaryType, lambda kind: Schema(type="string", format="base64"))
    try:
        assert schema_from_struct(T.StructType([T.StructField("b", T.BinaryType())])).properties["b"].format == "base64"
    finally:
        reverse._OWN.clear()
    assert schema_of_enum(Enum("E", {"A": "a", "B": "b"})).enum == ("a", "b") and schema_of_enum(Enum("E", {"A": "a"})).const == "a"
    for bad in (Enum("E", {"A": ("x", 1)}), Enum("E", {"A": 1})):
        with pytest.raises(UnsupportedType):
            schema_of_enum(bad)
    with pytest.raises(UnsupportedType):
        schema_for(T.StringType(), {"enum": ["a", 1]})


def test_reverse():
    kind = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("n", T.ByteType()), T.StructField("a", T.StructType([T.StructField("x", T.LongType())])), T.StructField("b", T.ArrayType(T.StructType([T.StructField("x", T.LongType())]))), T.StructField("e", T.StringType(), True, {"enum": ["p", "q"]}), T.StructField("c", T.StringType(), True, {"enum": ["p"]}), T.StructField("m", T.MapType(T.StringType(), T.BooleanType())), T.StructField("r", T.StringType(), True, {"rename": "R", "min_length": 2})])
    s = schema_from_struct(kind, title="Root")
    assert s.schema == SpecVersion.DRAFT_2020_12.value and s.required == ("id",) and s.additional_properties is Extra.FORBID and s.title == "Root"
    assert (s.properties["n"].minimum, s.properties["n"].maximum) == (-128, 127) and s.properties["a"].ref == "#/$defs/A" and s.properties["b"].items.ref == "#/$defs/B"
    assert s.properties["e"].enum == ("p", "q") and s.properties["c"].const == "p" and s.properties["R"].min_length == 2 and s.properties["m"].additional_properties.type == "boolean"
    assert Schema.of(s.to_json()).to_json() == s.to_json()
    again = struct_type(obj({"b": {"type": "integer", "minimum": 0, "maximum": 255}}, required=["b"]))
    assert schema_from_struct(again).properties["b"].maximum == 255
    assert schema_for(T.DoubleType()).maximum > 1e308
    nested = Schema.of(obj({"a": obj({}, **{"$defs": {"X": STR}})}, **{"$defs": {"Y": {"$defs": {"X": {"type": "integer"}, "Z": {}}}}}))
    assert set(hoist_defs(nested).defs) == {"X", "Y", "Z"} and hoist_defs(nested).defs["X"].type == "string"
