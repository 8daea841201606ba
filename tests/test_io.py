"""Sources, sinks, typed projection, the table function, streams, the command line and the driver contract."""

import importlib
import io
import json
import sys

import pytest

import __spark_entry__ as entry
from variantforge import cli
from variantforge.functions.udtf import register
from variantforge.operators.corpus import dedupe_classes, parse_status, require_parsed, struct_rows
from variantforge.operators.project import typed_projection
from variantforge.plans.models import DdlBackend
from variantforge.plans.schema import SchemaParseError
from variantforge.sources.scan import MissingInput, read_document_text, read_documents, read_schema_files, write_models
from variantforge.streaming.quarantine import quarantine

SCHEMA = {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}


def test_schema_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("a.json", json.dumps(SCHEMA)), ("deep/b.json", json.dumps(SCHEMA)), ("c.txt", "no")):
        (tmp_path / "in" / name).write_text(text)
    found = read_schema_files(spark, str(tmp_path / "in"), str(tmp_path / "in" / "a.json"))
    assert sorted(r["file_path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.json", "b.json"]
    with pytest.raises(MissingInput):
        read_schema_files(spark, str(tmp_path / "gone"))
    assert [place for _, place in cli.find_schema_files([str(tmp_path / "in"), "-", str(tmp_path / "in" / "deep" / "b.json"), "-"])] == ["a.json", "deep/b.json", "stdin"]
    index, path = write_models([SCHEMA], DdlBackend(), str(tmp_path / "out"))
    assert open(path).read().startswith("id BIGINT") and open(index).read() == "schema_0\n"


def test_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id": 1}\n{"id": 2}\n')
    assert read_documents(spark, str(tmp_path / "d.json")).selectExpr("variant_get(doc, '$.id', 'int') AS id").count() == 2
    assert read_document_text(spark, str(tmp_path / "d.json")).first()["doc"].startswith('{"id": 1}')


def test_corpus_failures_are_all_named(spark):
    status = parse_status(spark.createDataFrame([(1, "{"), (2, "{}"), (3, "[]")], "id int, t string"), "id", "t")
    with pytest.raises(SchemaParseError, match="2 schema"):
        require_parsed(status)
    assert require_parsed(status.where("id = 2")).count() == 1
    classes = dedupe_classes(struct_rows(spark.createDataFrame([(i, json.dumps(SCHEMA)) for i in range(5)], "id int, t string"), "id", "t")).collect()
    assert [(r["model"], r["first_schema"], r["occurrences"], r["shared"]) for r in classes] == [("Root", 0, 5, True)]


def test_typed_projection(spark):
    schema = {"type": "object", "properties": {"a": {"type": "string", "default": "foo"}, "n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}, "o": {"type": "object", "properties": {"x": {"type": "boolean"}}}}, "additionalProperties": {"type": "string"}}
    docs = ["{}", '{"a": null, "n": 1.0}', '{"a": "b", "n": 3, "l": [1, 2.5, "x"], "o": {"x": true}, "z": "extra"}', "[]", "{", None]
    got = [r["typed"] and r["typed"].asDict(True) for r in typed_projection(spark.createDataFrame([(d,) for d in docs], "doc string").coalesce(1), "doc", schema).collect()]
    assert got[0] == {"a": "foo", "l": None, "n": None, "o": None, "additional": {}}
    assert got[1]["a"] is None and got[1]["n"] is None
    assert got[2] == {"a": "b", "l": [1.0, 2.5, None], "n": 3, "o": {"x": True}, "additional": {"z": "extra"}}
    assert got[3:] == [None, None, None]


def test_table_function(spark):
    register(spark)
    got = spark.sql("SELECT ord, kind, path FROM json_schema_errors('{\"id\": \"x\"}', '" + json.dumps(SCHEMA) + "')").collect()
    assert [tuple(r) for r in got] == [(0, "ExpectedInteger", "/id")]
    assert spark.sql("SELECT * FROM json_schema_errors('{', '{}')").count() == 0


def test_stream_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, lines in enumerate((['{"id": 1}', '{"id": "x"}'], ["{", '{"id": 2}'])):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines))
    stream = spark.readStream.schema("doc string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    query = quarantine(stream, "doc", SCHEMA, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert sorted(r["doc"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == ['{"id": 1}', '{"id": 2}']
    assert sorted(r["doc"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["{", '{"id": "x"}']


def test_cli(tmp_path, capsys):
    schema, good, bad = (tmp_path / n for n in ("s.json", "g.json", "b.json"))
    schema.write_text(json.dumps(SCHEMA))
    good.write_text('{"id": 1}')
    bad.write_text("{}")
    assert cli.main(["validate", "-s", str(schema), "-p", str(good)]) == 0
    assert cli.main(["validate", "-s", str(schema), "-p", str(bad)]) == 1
    assert 'missing required property "id"' in capsys.readouterr().err
    assert cli.main(["generate", "ddl", "-o", str(tmp_path / "out"), str(schema)]) == 0
    bad.write_text("[")
    assert cli.main(["generate", "ddl", "-o", str(tmp_path / "out"), str(bad), str(schema)]) == 1


def test_generate_mirrors_folders_and_writes_indexes(tmp_path, capsys):
    port = {"type": "object", "title": "Port", "properties": {"city": {"type": "string"}}}
    trip = lambda key: json.dumps({"type": "object", "title": key, "properties": {key: port}})
    (tmp_path / "in" / "a b" / "2x").mkdir(parents=True)
    for place in ("top.json", "a b/my-trip.json", "a b/2x/deep.json"):
        (tmp_path / "in" / place).write_text(trip(place[:3].strip()))
    (tmp_path / "in" / "other.txt").write_text("no")
    out = tmp_path / "out"
    assert cli.main(["generate", "struct", "-o", str(out), str(tmp_path / "in"), "--dedupe-mode", "functional"]) == 0
    written = sorted(str(p.relative_to(out)) for p in out.rglob("*.py"))
    assert written == ["__init__.py", "a_b/_2x/__init__.py", "a_b/_2x/deep.py", "a_b/__init__.py", "a_b/my_trip.py", "shared.py", "top.py"]
    assert (out / "__init__.py").read_text().split("\n")[:-1] == ["from . import a_b", "from . import shared", "from . import top"]
    assert (out / "a_b" / "__init__.py").read_text().split("\n")[:-1] == ["from . import _2x", "from . import my_trip"]
    assert (out / "a_b" / "_2x" / "deep.py").read_text() == "from ...shared import AB, Port\n\nSCHEMA = AB\n"
    assert "\nfrom .shared import Port\n" in (out / "top.py").read_text()
    sys.path.insert(0, str(tmp_path))
    try:
        deep, top = importlib.import_module("out.a_b._2x.deep"), importlib.import_module("out.top")
    finally:
        sys.path.remove(str(tmp_path))
    assert top.SCHEMA.simpleString() == "struct<top:struct<city:string>>" and deep.SCHEMA["a b"].dataType == top.SCHEMA["top"].dataType
    for backend, ending in (("ddl", ".sql"), ("json", ".jsonl")):
        out = tmp_path / backend
        assert cli.main(["generate", backend, "-o", str(out), str(tmp_path / "in")]) == 0
        assert "Port" in (out / f"shared{ending}").read_text() and "Port" in (out / "a_b" / "_2x" / f"deep{ending}").read_text()
    assert '"from": "../../shared"' in (out / "a_b" / "_2x" / "deep.jsonl").read_text()


def test_generate_reads_standard_input_among_files(tmp_path, monkeypatch, capsys):
    (tmp_path / "s.json").write_text(json.dumps(SCHEMA))
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(SCHEMA)))
    assert cli.main(["generate", "json", "-o", str(tmp_path / "out"), str(tmp_path / "s.json"), "-"]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["index.jsonl", "s.jsonl", "shared.jsonl", "stdin.jsonl"]
    monkeypatch.setattr("sys.stdin", io.StringIO('{"id": 1}'))
    assert cli.main(["validate", "-s", str(tmp_path / "s.json"), "-p", "-"]) == 0


def test_generate_options_and_failures(tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"type": "object", "properties": {"x": {"type": "object", "title": "Other", "properties": {"n": {"type": "integer"}}}}}))
    (tmp_path / "b.json").write_text(json.dumps(SCHEMA | {"unknown": 1}))
    for source, name in (("title-first", "Other"), ("property-key", "X")):
        assert cli.main(["generate", "json", "-o", str(tmp_path / source), str(tmp_path / "a.json"), "--model-name-source", source]) == 0
        assert f'"model": "{name}"' in (tmp_path / source / "a.jsonl").read_text()
    assert cli.main(["generate", "json", "-o", str(tmp_path / "no"), "--disallow-unknown-fields", str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == 1
    assert "b.json" in capsys.readouterr().err and not (tmp_path / "no").exists()
    assert cli.main(["generate", "json", "-o", str(tmp_path / "no"), str(tmp_path / "gone")]) == 1
    (tmp_path / "d").mkdir()
    for n in ("x-y.json", "x y.json"):
        (tmp_path / "d" / n).write_text(json.dumps(SCHEMA))
    assert cli.main(["generate", "json", "-o", str(tmp_path / "no"), str(tmp_path / "d")]) == 1
    assert "one file" in capsys.readouterr().err


def test_driver_contract(spark):
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 40
    assert entry.entry(spark).count() > 0
