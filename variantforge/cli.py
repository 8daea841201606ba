"""Command line: ``validate`` one document, or ``generate`` models from schema files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .operators.interpret import check_terminates, validate
from .plans.dedupe import DedupeMode
from .plans.errors import message
from .plans.merge import MappingError
from .plans.models import DdlBackend, JsonBackend, MappingSettings, NameSource, StructTypeBackend
from .plans.schema import Schema, SchemaParseError, SchemaSettings
from .plans.values import InvalidJson, parse_json
from .sources.scan import write_models

BACKENDS = {"ddl": DdlBackend, "json": JsonBackend, "struct": StructTypeBackend}


#: Name of the output of a schema from standard input.
STDIN = "stdin"


def find_schema_files(inputs: list[str]) -> list[tuple[str, str]]:
    """(source, output relative) of files, of all `*.json` below folders, and of `-` (standard input), in order; each file once, by its real path.

    A folder's files keep their place below it, a file given by itself goes to the top.
    """
    found: dict[str, tuple[str, str]] = {}
    for name in inputs:
        if name == "-":
            found.setdefault("-", ("-", STDIN))
            continue
        path = Path(name)
        if not path.exists():
            raise FileNotFoundError(f"no such file or folder: {name}")
        for p in sorted(path.rglob("*.json")) if path.is_dir() else [path]:
            if p.is_file():
                found.setdefault(str(p.resolve()), (str(p), str(p.relative_to(path)) if path.is_dir() else p.name))
    return list(found.values())


def _read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def _validate(args: argparse.Namespace) -> int:
    settings = SchemaSettings(disallow_unknown_fields=args.disallow_unknown_fields)
    schema = Schema.of(_read(args.schema), settings)
    check_terminates(schema)
    errors = validate(schema, parse_json(_read(args.payload)))
    for e in errors:
        print(message(e), file=sys.stderr)
    if errors:
        print(f"validation failed: {len(errors)} error(s)", file=sys.stderr)
    return int(bool(errors))


def _generate(args: argparse.Namespace) -> int:
    settings = SchemaSettings(disallow_unknown_fields=args.disallow_unknown_fields)
    schemas, places, failed = [], [], 0
    for name, place in find_schema_files(args.inputs):
        try:
            schemas.append(Schema.of(_read(name), settings))
            places.append(place)
        except (SchemaParseError, UnicodeDecodeError) as e:
            failed += 1
            print(f"{'stdin' if name == '-' else name}: {e}", file=sys.stderr)
    if failed or not schemas:
        print(f"{failed} schema(s) failed" if failed else "no schema found", file=sys.stderr)
        return 1
    mapping = MappingSettings(NameSource(args.model_name_source), DedupeMode(args.dedupe_mode))
    for path in write_models(schemas, BACKENDS[args.backend](), args.output, mapping, places):
        print(path)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="variantforge")
    sub = parser.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate", help="validate one JSON document; errors go to stderr and the exit code is 1")
    v.add_argument("-s", "--schema", required=True)
    v.add_argument("-p", "--payload", default="-")
    v.set_defaults(run=_validate)
    g = sub.add_parser("generate", help="write models of schema files")
    g.add_argument("backend", choices=sorted(BACKENDS))
    g.add_argument("-o", "--output", required=True)
    g.add_argument("inputs", nargs="+")
    g.add_argument("--model-name-source", choices=[x.value for x in NameSource], default=NameSource.TITLE_FIRST.value)
    g.add_argument("--dedupe-mode", choices=[x.value for x in DedupeMode], default=DedupeMode.FULL.value)
    g.set_defaults(run=_generate)
    for p in (v, g):
        p.add_argument("--disallow-unknown-fields", action="store_true")
    args = parser.parse_args(argv)
    try:
        return args.run(args)
    except (SchemaParseError, InvalidJson, MappingError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
