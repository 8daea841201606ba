"""Schema corpora as tables: parsing, nodes, deduplication and references, one schema a row.

Schemas are parsed in Arrow batches on the executors; grouping by structural key is a shuffle with partial
aggregation, so a key that a third of all schemas share is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dedupe import DedupeMode, dedupe_key
from ..plans.merge import MappingError, merged
from ..plans.models import MODEL_ROW, Generated, Mapper, MappingSettings, model_rows
from ..plans.refs import RefError, follow
from ..plans.schema import Extra, Schema, SchemaParseError, SchemaSettings


def _mapped(df: DataFrame, columns: list[str], fields: str, rows: Callable) -> DataFrame:
    """mapInArrow over columns; rows(values) yields tuples for the fields."""
    names = [f.strip().split()[0].strip("`") for f in fields.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.strip().split()[1]] for f in fields.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for values in zip(*(batch.column(i).to_pylist() for i in range(len(columns))), strict=True) for r in rows(*values)]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return df.select(*columns).mapInArrow(run, fields)


def parse_status(schemas: DataFrame, id_col: str, text_col: str, settings: SchemaSettings = SchemaSettings()) -> DataFrame:
    """(id, schema_json, error): the whole normalised text of each schema, which reads back as the same, or why it does not parse."""

    def rows(i, text):
        try:
            yield i, Schema.of(text if text is not None else "", settings).to_json(whole=True), None
        except SchemaParseError as e:
            yield i, None, str(e)

    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), ["id", "text"], "id bigint, schema_json string, error string", rows)


def require_parsed(status: DataFrame) -> DataFrame:
    """status, after all rows parsed; else an error that names how many failed and the first few."""
    failed = status.where("error IS NOT NULL").orderBy("id")
    first = failed.limit(5).collect()
    if first:
        raise SchemaParseError(f"{failed.count()} schema(s) failed: " + "; ".join(f"{r['id']}: {r['error']}" for r in first))
    return status


def _walk(root: Schema):
    """(node_id, parent_id, edge, node) of all nodes, parents first, in the order of keywords and keys."""
    stack, next_id = [(None, "", root)], 0
    while stack:
        parent, edge, node = stack.pop()
        mine, next_id = next_id, next_id + 1
        yield mine, parent, edge, node
        children = [(f"{word}/{k}", v) for word, group in (("$defs", node.defs), ("definitions", node.definitions), ("properties", node.properties)) for k, v in (group or {}).items()]
        children += [(word, v) for word, v in (("items", node.items), ("additionalProperties", node.additional_properties)) if isinstance(v, Schema)]
        children += [(f"{word}/{i}", v) for word, group in (("allOf", node.all_of), ("anyOf", node.any_of), ("oneOf", node.one_of)) for i, v in enumerate(group or ())]
        stack.extend((mine, e, v) for e, v in reversed(children))


def schema_nodes(schemas: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per node: schema_id, node_id, parent_id, edge, type, ref, title, is_required, closed."""

    def rows(i, text):
        required: dict[int, tuple] = {}
        for node_id, parent, edge, node in _walk(Schema.of(text)):
            required[node_id] = node.required or ()
            needed = edge.startswith("properties/") and edge.removeprefix("properties/") in required[parent]
            yield i, node_id, parent, edge, node.type, node.ref, node.title, needed, node.additional_properties is Extra.FORBID

    fields = "schema_id bigint, node_id bigint, parent_id bigint, edge string, type string, ref string, title string, is_required boolean, closed boolean"
    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], fields, rows)


def resolve_refs(schemas: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per reference: schema_id, node_id, ref, target_type, reason (null if it resolves)."""

    def rows(i, text):
        root = Schema.of(text)
        for node_id, _, _, node in _walk(root):
            if node.ref is not None:
                try:
                    yield i, node_id, node.ref, follow(root, node).type, None
                except RefError as e:
                    yield i, node_id, node.ref, None, e.reason

    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], "schema_id bigint, node_id bigint, ref string, target_type string, reason string", rows)


def struct_rows(schemas: DataFrame, id_col: str, text_col: str, settings: MappingSettings = MappingSettings()) -> DataFrame:
    """One row per struct of each schema, children first: schema_id, ord, model, key, error."""

    def rows(i, text):
        try:
            structs = [m for m in Mapper(Schema.of(text), settings).models() if m.kind == "struct"]
        except (MappingError, SchemaParseError) as e:
            yield i, None, None, None, str(e)
            return
        for ord, m in enumerate(structs):
            yield i, ord, m.name, m.key, None

    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], "schema_id bigint, ord int, model string, key string, error string", rows)


def dedupe_classes(structs: DataFrame) -> DataFrame:
    """Classes of equal keys: key_hash, model (of the first occurrence), first_schema, occurrences, shared."""
    at = F.struct("schema_id", "ord")
    found = structs.where("key IS NOT NULL").groupBy(F.sha2("key", 256).alias("key_hash")).agg(F.min_by("model", at).alias("model"), F.min("schema_id").alias("first_schema"), F.count("*").alias("occurrences"))
    return found.withColumn("shared", F.col("occurrences") > 1)


def schema_classes(schemas: DataFrame, id_col: str, text_col: str, mode: DedupeMode = DedupeMode.FULL, strict: bool = False) -> DataFrame:
    """Whole schemas by structural key: key_hash, first_schema, occurrences."""

    def rows(i, text):
        yield i, dedupe_key(Schema.of(text), mode, strict)

    keyed = _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], "schema_id bigint, key string", rows)
    return keyed.groupBy(F.sha2("key", 256).alias("key_hash")).agg(F.min("schema_id").alias("first_schema"), F.count("*").alias("occurrences"))


def merge_status(schemas: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(schema_id, merged_json, error): each schema with its allOf as one object schema, or why its branches do not merge."""

    def rows(i, text):
        try:
            yield i, merged(Schema.of(text)).to_json(whole=True), None
        except (MappingError, SchemaParseError) as e:
            yield i, None, str(e)

    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], "schema_id bigint, merged_json string, error string", rows)


def model_table(schemas: DataFrame, id_col: str, text_col: str, settings: MappingSettings = MappingSettings()) -> DataFrame:
    """The model rows of each schema by itself: schema_id, error (then all else is null) and the columns of MODEL_ROW."""
    width = len(MODEL_ROW.split(","))

    def rows(i, text):
        try:
            models = Mapper(Schema.of(text), settings).models()
        except (MappingError, SchemaParseError) as e:
            yield i, str(e), *[None] * width
            return
        for row in model_rows(Generated(tuple((0, j, m, False) for j, m in enumerate(models)))):
            yield i, None, *row

    return _mapped(schemas.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")), ["i", "t"], f"schema_id bigint, error string, {MODEL_ROW}", rows)
