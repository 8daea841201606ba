"""The registered queries of the engine and their DuckDB equivalents.

Documents are built from the driver's tables with to_json, which leaves nulls out; the SQL reads the plain
columns, so it does not depend on any JSON parser.  Queries return keys, kinds, paths and payloads.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as N
from .functions import pointer as P
from .functions import refs as R
from .operators import corpus
from .operators.project import typed_projection
from .operators.validate import explode_errors, error_summary, split_valid, validate_documents
from .plans.dedupe import DedupeMode
from .plans.models import MODEL_ROW, MappingSettings, NameSource, ddl_of, generate, model_rows, numeric_type, struct_of_model, struct_types
from .plans.reverse import hoist_defs, schema_from_struct
from .plans.schema import Schema, SchemaSettings
from .sources.scan import documents_of, module_index
from .streaming.quarantine import rejection_rates

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "val_event_props_max"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL if SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data: list[tuple], fields: str) -> DataFrame:
    return spark.createDataFrame(data, fields)


def errors(df: DataFrame, schema: dict, *keys: str, doc: str = "doc", tier: str = "auto") -> DataFrame:
    return explode_errors(validate_documents(df, doc, schema, tier), *keys)


def obj(properties: dict, **more) -> dict:
    return {"type": "object", "properties": properties, **more}


# Validation

PROPS = obj({"k": {"type": "integer", "maximum": 50}}, required=["k"])


@query("SELECT event_id, '/k' AS path, 'AboveMaximum' AS kind, CAST(json_extract(props, '$.k') AS BIGINT)::DOUBLE AS d_actual FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def val_event_props_max(spark, sf_dir):
    return errors(table(spark, sf_dir, "events").select("event_id", "props"), PROPS, "event_id", doc="props").select("event_id", "path", "kind", "d_actual")


@query("SELECT event_id, '/k' AS path, 'AboveMaximum' AS kind, '/k: value ' || CAST(json_extract(props, '$.k') AS VARCHAR) || ' is above maximum 50' AS message FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def val_interpreted_messages(spark, sf_dir):
    return errors(table(spark, sf_dir, "events").select("event_id", "props"), PROPS, "event_id", doc="props", tier="interpreted").select("event_id", "path", "kind", "message")


def orders(spark, sf_dir) -> DataFrame:
    return documents_of(table(spark, sf_dir, "orders")).select("o_orderkey", "doc")


@query("SELECT o_orderkey, ord::INT AS ord, '/' || p AS path, 'MissingRequired' AS kind, p AS property FROM orders, (VALUES ('o_clerk', 1), ('o_custkey', 0)) v(p, n), LATERAL (SELECT CASE WHEN p = 'o_custkey' THEN 0 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS ord) WHERE p = 'o_clerk' OR o_orderkey % 7 = 0")
def val_order_required(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))
    schema = obj({}, required=["o_orderkey", "o_custkey", "o_clerk"])
    return errors(documents_of(df).select("o_orderkey", "doc"), schema, "o_orderkey").select("o_orderkey", "ord", "path", "kind", "property")


@query("SELECT o_orderkey, 'NotInEnum' AS kind, '\"' || o_orderstatus || '\"' AS actual, '/o_orderstatus: value \"' || o_orderstatus || '\" not in enum (allowed: \"F\", \"O\")' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def val_order_enum(spark, sf_dir):
    return errors(orders(spark, sf_dir), obj({"o_orderstatus": {"type": "string", "enum": ["F", "O"]}}), "o_orderkey").select("o_orderkey", "kind", "actual", "message")


@query("SELECT o_orderkey, 'NotConst' AS kind, '\"F\"' AS expected, '\"' || o_orderstatus || '\"' AS actual FROM orders WHERE o_orderstatus <> 'F'")
def val_order_const(spark, sf_dir):
    return errors(orders(spark, sf_dir), obj({"o_orderstatus": {"const": "F"}}), "o_orderkey").select("o_orderkey", "kind", "expected", "actual")


@query("SELECT o_orderkey, 'PatternMismatch' AS kind, o_orderpriority AS actual FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-')")
def val_order_pattern(spark, sf_dir):
    return errors(orders(spark, sf_dir), obj({"o_orderpriority": {"type": "string", "pattern": "^[1-3]-"}}), "o_orderkey").select("o_orderkey", "kind", "actual")


@query("SELECT o_orderkey, '/o_orderpriority' AS path, 'InvalidPatternInSchema' AS kind FROM orders")
def val_invalid_pattern(spark, sf_dir):
    return errors(orders(spark, sf_dir), obj({"o_orderpriority": {"type": "string", "pattern": "["}}), "o_orderkey").select("o_orderkey", "path", "kind")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'BelowMinimum' ELSE 'AboveMaximum' END AS kind, o_totalprice AS d_actual FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 400000")
def val_order_bounds(spark, sf_dir):
    return errors(orders(spark, sf_dir), obj({"o_totalprice": {"type": "number", "minimum": 50000, "maximum": 400000}}), "o_orderkey").select("o_orderkey", "kind", "d_actual")


@query("SELECT l_orderkey, l_linenumber, 'ExpectedInteger' AS kind, 'number' AS actual FROM lineitem WHERE l_quantity IS NOT NULL")
def val_lineitem_integer_type(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "doc")
    return errors(df, obj({"l_quantity": {"type": "integer"}}), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "kind", "actual")


@query("SELECT p_partkey, '/p_retailprice' AS path, 'ExpectedString' AS kind, 'number' AS actual FROM part UNION ALL SELECT p_partkey, '/p_name', 'ExpectedNumber', 'string' FROM part UNION ALL SELECT p_partkey, '/p_size', 'ExpectedBoolean', 'number' FROM part UNION ALL SELECT p_partkey, '/p_brand', 'ExpectedArray', 'string' FROM part UNION ALL SELECT p_partkey, '/p_type', 'ExpectedObject', 'string' FROM part")
def val_type_mismatches(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "part")).select("p_partkey", "doc")
    kinds = {"p_retailprice": "string", "p_name": "number", "p_size": "boolean", "p_brand": "array", "p_type": "object"}
    return errors(df, obj({k: {"type": t} for k, t in kinds.items()}), "p_partkey").select("p_partkey", "path", "kind", "actual")


@query("SELECT p_partkey, CASE WHEN length(p_name) < 9 THEN 'TooShort' ELSE 'TooLong' END AS kind, length(p_name)::BIGINT AS n_actual FROM part WHERE length(p_name) < 9 OR length(p_name) > 11")
def val_part_length(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "part"), "p_name").select("p_partkey", "doc")
    return errors(df, obj({"p_name": {"type": "string", "minLength": 9, "maxLength": 11}}), "p_partkey").select("p_partkey", "kind", "n_actual")


@query("SELECT doc_id, CASE WHEN length(text) < 500 THEN 'TooShort' ELSE 'TooLong' END AS kind, length(text)::BIGINT AS n_actual FROM documents WHERE length(text) < 500 OR length(text) > 3000")
def val_docs_length_unicode(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "documents"), "text").select("doc_id", "doc")
    return errors(df, obj({"text": {"type": "string", "minLength": 500, "maxLength": 3000}}), "doc_id").select("doc_id", "kind", "n_actual")


@query("SELECT conv_id, turn, '/role' AS path, 'NotInEnum' AS kind FROM conversations WHERE role <> 'user' UNION ALL SELECT conv_id, turn, '/text', 'TooLong' FROM conversations WHERE length(text) > 500")
def val_conversations_role(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "conversations"), "role", "text").select("conv_id", "turn", "doc")
    schema = obj({"role": {"type": "string", "enum": ["user"]}, "text": {"type": "string", "maxLength": 500}})
    return errors(df, schema, "conv_id", "turn").select("conv_id", "turn", "path", "kind")


@query("SELECT page_id, 'PatternMismatch' AS kind, url AS actual FROM pages WHERE NOT regexp_matches(url, '^https://(www|m)\\.')")
def val_pages_url_pattern(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "pages"), "url").select("page_id", "doc")
    return errors(df, obj({"url": {"type": "string", "pattern": "^https:\\/\\/(www|m)\\."}}), "page_id").select("page_id", "kind", "actual")


@query("SELECT c_custkey, ord::INT AS ord, '/' || k AS path, 'DisallowedAdditionalProperty' AS kind, k AS property FROM customer, (VALUES ('c_acctbal', 0), ('c_mktsegment', 1), ('c_nationkey', 2)) v(k, ord)")
def val_additional_forbid(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    return errors(df, obj({"c_custkey": {}, "c_name": {}}, additionalProperties=False), "c_custkey").select("c_custkey", "ord", "path", "kind", "property")


@query("SELECT c_custkey, ord::INT AS ord, '/' || k AS path, 'ExpectedString' AS kind FROM customer, (VALUES ('c_nationkey', 0), ('c_acctbal', 1)) v(k, ord)")
def val_additional_schema(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    return errors(df, obj({"c_custkey": {}, "c_name": {}}, additionalProperties={"type": "string"}), "c_custkey").select("c_custkey", "ord", "path", "kind")


BALANCE = {"type": "number", "maximum": 0}
SEGMENT = {"enum": ["BUILDING"]}
EITHER = [obj({"c_acctbal": BALANCE}), obj({"c_mktsegment": SEGMENT})]


@query("SELECT c_custkey, 'NoSubschemaMatched' AS kind, 2::BIGINT AS n_expected FROM customer WHERE NOT (c_acctbal <= 0 OR c_mktsegment = 'BUILDING')")
def val_anyof(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    return errors(df, {"anyOf": EITHER, "required": ["hidden"]}, "c_custkey").select("c_custkey", "kind", "n_expected")


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'MultipleSubschemasMatched' ELSE 'NoSubschemaMatched' END AS kind, CASE WHEN c_acctbal <= 0 THEN 2::BIGINT END AS n_actual FROM customer WHERE (c_acctbal <= 0)::INT + (c_mktsegment = 'BUILDING')::INT <> 1")
def val_oneof(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    return errors(df, {"oneOf": EITHER}, "c_custkey").select("c_custkey", "kind", "n_actual")


@query("SELECT c_custkey, '/c_acctbal' AS path, 'AboveMaximum' AS kind FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, '/c_mktsegment', 'NotInEnum' FROM customer WHERE c_mktsegment <> 'BUILDING'")
def val_allof(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    return errors(df, {"allOf": EITHER}, "c_custkey").select("c_custkey", "path", "kind")


@query("SELECT s_suppkey, '/s_phone' AS path, 'MissingRequired' AS kind FROM supplier")
def val_untyped_arm(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "supplier")).select("s_suppkey", "doc")
    schema = {"required": ["s_phone"], "properties": {"s_name": {"minLength": 9999, "pattern": "^$"}}, "additionalProperties": False}
    return errors(df, schema, "s_suppkey").select("s_suppkey", "path", "kind")


def nested_orders(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return lines.withColumn("doc", F.to_json(F.struct("lines"))).select("l_orderkey", "doc")


LINES = {"$defs": {"Line": obj({"l_quantity": {"type": "number", "maximum": 45}, "l_linenumber": {"type": "integer"}}, required=["l_partkey"])}, **obj({"lines": {"type": "array", "minItems": 2, "maxItems": 6, "items": {"$ref": "#/$defs/Line"}}})}
NESTED_SQL = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem)
SELECT l_orderkey, '/lines/' || i || '/l_quantity' AS path, 'AboveMaximum' AS kind, l_quantity AS d_actual, NULL::BIGINT AS n_actual FROM n WHERE l_quantity > 45
UNION ALL SELECT l_orderkey, '/lines', CASE WHEN count(*) < 2 THEN 'TooFewItems' ELSE 'TooManyItems' END, NULL, count(*) FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 6
"""


@query(NESTED_SQL)
def val_order_items_nested(spark, sf_dir):
    return errors(nested_orders(spark, sf_dir), LINES, "l_orderkey").select("l_orderkey", "path", "kind", "d_actual", "n_actual")


@query(NESTED_SQL)
def val_order_items_interpreted(spark, sf_dir):
    return errors(nested_orders(spark, sf_dir), LINES, "l_orderkey", tier="interpreted").select("l_orderkey", "path", "kind", "d_actual", "n_actual")


@query("SELECT vec_id, '/embedding/' || (i - 1) AS path, 'BelowMinimum' AS kind FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE x < -0.25::FLOAT UNION ALL SELECT vec_id, '/embedding', 'TooManyItems' FROM embeddings WHERE len(embedding) > 63")
def val_embeddings_items(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "doc")
    schema = obj({"embedding": {"type": "array", "maxItems": 63, "items": {"type": "number", "minimum": -0.25}}})
    return errors(df, schema, "vec_id").select("vec_id", "path", "kind")


@query("SELECT l_orderkey, '/parts' AS path, 'DuplicateArrayItems' AS kind FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_partkey)")
def val_unique_items(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    df = parts.withColumn("doc", F.to_json(F.struct("parts"))).select("l_orderkey", "doc")
    return errors(df, obj({"parts": {"type": "array", "uniqueItems": True, "items": {"type": "integer"}}}), "l_orderkey").select("l_orderkey", "path", "kind")


EMPTY_SQL = "SELECT c_custkey, 'anyOf' AS word, '/c_name' AS path, 'NoSubschemaMatched' AS kind, 0::BIGINT AS n_expected FROM customer UNION ALL SELECT c_custkey, 'oneOf', '/c_name', 'NoSubschemaMatched', 0 FROM customer"


def _empty_combinators(spark, sf_dir, tier):
    df = documents_of(table(spark, sf_dir, "customer")).select("c_custkey", "doc")
    found = None
    for word in ("anyOf", "oneOf"):
        part = errors(df, obj({"c_name": {word: []}, "absent": {word: []}}), "c_custkey", tier=tier).select("c_custkey", F.lit(word).alias("word"), "path", "kind", "n_expected")
        found = part if found is None else found.unionByName(part)
    return found


@query(EMPTY_SQL)
def val_empty_combinators(spark, sf_dir):
    return _empty_combinators(spark, sf_dir, "compiled")


@query(EMPTY_SQL)
def val_empty_combinators_interpreted(spark, sf_dir):
    return _empty_combinators(spark, sf_dir, "interpreted")


@query("SELECT s_suppkey, '/s_name' AS path, 'InvalidRef' AS kind, 'DefNotFound { ref_str: \"#/$defs/Gone\", name: \"Gone\" }' AS expected FROM supplier UNION ALL SELECT s_suppkey, '/s_nationkey', 'InvalidRef', 'RefCycle { ref_str: \"#/$defs/A\" }' FROM supplier")
def val_invalid_ref(spark, sf_dir):
    df = documents_of(table(spark, sf_dir, "supplier")).select("s_suppkey", "doc")
    schema = {"$defs": {"A": {"$ref": "#/$defs/B"}, "B": {"$ref": "#/$defs/A"}}, **obj({"s_name": {"$ref": "#/$defs/Gone"}, "s_nationkey": {"$ref": "#/$defs/A"}})}
    return errors(df, schema, "s_suppkey").select("s_suppkey", "path", "kind", "expected")


@query("SELECT n_nationkey, '/child/child/n' AS path, 'ExpectedString' AS kind FROM nation")
def val_recursive_schema(spark, sf_dir):
    inner = F.struct(F.col("n_nationkey").alias("n"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.struct(inner.alias("child")).alias("child"))).alias("doc"))
    return errors(df, obj({"child": {"$ref": "#"}, "n": {"type": "string"}}), "n_nationkey").select("n_nationkey", "path", "kind")


@query("SELECT n_nationkey, 'InvalidUuidFormat' AS kind FROM nation WHERE n_nationkey % 2 = 1")
def val_uuid_format(spark, sf_dir):
    from .operators.interpret import ValidationOptions

    good = F.concat(F.lit("123e4567-e89b-12d3-a456-4266141740"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.when(F.col("n_nationkey") % 2 == 0, good).otherwise("nope").alias("u"))).alias("doc"))
    found = validate_documents(df, "doc", obj({"u": {"type": "string", "format": "uuid"}}), options=ValidationOptions(enable_uuid=True))
    return explode_errors(found, "n_nationkey").select("n_nationkey", "kind")


SUMMARY = obj({"o_orderstatus": {"enum": ["F", "O"]}, "o_totalprice": {"type": "number", "maximum": 400000}, "o_orderpriority": {"type": "string", "pattern": "^[1-3]-"}}, required=["o_clerk"])


@query("SELECT '/o_clerk' AS path, 'MissingRequired' AS kind, count(*) AS n_errors, count(*) AS n_documents FROM orders UNION ALL SELECT '/o_orderpriority', 'PatternMismatch', count(*), count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-') UNION ALL SELECT '/o_orderstatus', 'NotInEnum', count(*), count(*) FROM orders WHERE o_orderstatus NOT IN ('F','O') UNION ALL SELECT '/o_totalprice', 'AboveMaximum', count(*), count(*) FROM orders WHERE o_totalprice > 400000")
def val_error_summary(spark, sf_dir):
    return error_summary(validate_documents(orders(spark, sf_dir), "doc", SUMMARY))


@query("SELECT CASE WHEN o_orderstatus IN ('F','O') AND o_totalprice <= 400000 THEN 'valid' ELSE 'rejected' END AS side, count(*) AS n FROM orders GROUP BY 1")
def val_is_valid_split(spark, sf_dir):
    good, bad = split_valid(validate_documents(orders(spark, sf_dir), "doc", obj({k: v for k, v in SUMMARY["properties"].items() if k != "o_orderpriority"})))
    both = good.select(F.lit("valid").alias("side")).unionByName(bad.select(F.lit("rejected").alias("side")))
    return both.groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id % 3 = 0 AS invalid_json, (CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END)::INT AS n_errors FROM events")
def val_invalid_json(spark, sf_dir):
    doc = F.when(F.col("event_id") % 3 == 0, '{"k": ').when(F.col("event_id") % 3 == 1, "[]").otherwise('{"k": 1}')
    found = validate_documents(table(spark, sf_dir, "events").select("event_id", doc.alias("doc")), "doc", PROPS)
    return found.select("event_id", "invalid_json", F.size("errors").alias("n_errors"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_documents, sum((CAST(json_extract(props, '$.k') AS BIGINT) > 50)::INT)::BIGINT AS n_rejected FROM events GROUP BY 1")
def stream_rejection_rates(spark, sf_dir):
    return rejection_rates(validate_documents(table(spark, sf_dir, "events"), "props", PROPS), "ts")


@query("SELECT event_id, '/k' AS path, 'AboveMaximum' AS kind FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def val_sql_table_function(spark, sf_dir):
    from .functions.udtf import register

    register(spark)
    text = json.dumps(PROPS)
    return spark.sql("SELECT event_id, e.path, e.kind FROM {events} t, LATERAL json_schema_errors(t.props, :schema) e", args={"schema": text}, events=table(spark, sf_dir, "events"))


# Pointers

URL_POINTER = "'/pages/' || replace(replace(url, '~', '~0'), '/', '~1')"


def url_pointers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", P.push(F.lit("/pages"), F.col("url")).alias("p"))


@query(f"SELECT page_id, {URL_POINTER} AS p, {URL_POINTER} AS shown FROM pages")
def ptr_push(spark, sf_dir):
    return url_pointers(spark, sf_dir).select("page_id", "p", P.display(F.col("p")).alias("shown"))


@query("SELECT page_id, 2 AS n, url AS last, '/pages/' || replace(replace(url, '~', '~0'), '/', '~1') AS again FROM pages")
def ptr_parse(spark, sf_dir):
    s = P.segments(F.col("p"))
    return url_pointers(spark, sf_dir).select("page_id", P.length(F.col("p")).alias("n"), P.segment_at(F.col("p"), 1).alias("last"), P.from_segments(s).alias("again"))


@query("SELECT page_id, '/pages' AS parent, '' AS grandparent, 'root' AS shown FROM pages")
def ptr_pop(spark, sf_dir):
    up = P.pop(P.pop(P.pop(F.col("p"))))
    return url_pointers(spark, sf_dir).select("page_id", P.pop(F.col("p")).alias("parent"), up.alias("grandparent"), P.display(up).alias("shown"))


@query("SELECT page_id, '/' || split_part(url, '/', 1) || '/' || split_part(url, '/', 2) AS two FROM pages")
def ptr_truncate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.truncate(F.concat(F.lit("/"), F.col("url")), 2).alias("two"))


@query(f"SELECT page_id, replace({URL_POINTER}, '/pages', '') AS without, {URL_POINTER} AS same FROM pages")
def ptr_remove(spark, sf_dir):
    return url_pointers(spark, sf_dir).select("page_id", P.remove(F.col("p"), 0).alias("without"), P.remove(F.col("p"), 9).alias("same"))


@query("SELECT * FROM (VALUES ('', true, 0), ('/a~1b', true, 1), ('/a~2', false, NULL), ('a', false, NULL), ('/', true, 1), ('/x/~0/', true, 3)) v(p, ok, n)")
def ptr_validity(spark, sf_dir):
    df = rows(spark, [(x,) for x in ("", "/a~1b", "/a~2", "a", "/", "/x/~0/")], "p string")
    return df.select("p", P.is_pointer(F.col("p")).alias("ok"), F.size(P.segments(F.col("p"))).alias("n")).withColumn("n", F.when(F.col("ok"), F.col("n")))


# Names

SNAKE = "trim(lower(regexp_replace(regexp_replace(regexp_replace({}, '([a-z][0-9]*)([A-Z])', '\\1_\\2', 'g'), '([A-Z][0-9]*)([A-Z][a-z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_')"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'field_' || replace(k, '-', '_') ELSE {SNAKE.format('k')} END AS field FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey || '-' || p_brand ELSE p_type || '-' || p_brand END AS k FROM part)")
def san_field(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws("-", F.col("p_partkey").cast("string"), "p_brand")).otherwise(F.concat_ws("-", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", N.field_name(key).alias("field"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS component FROM pages")
def san_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.path_component(F.col("url")).alias("component"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[-. ]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS module FROM pages")
def san_module(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.module_name(F.col("url")).alias("module"))


NAME_ROWS = [("deck-plan", "deck_plan", "DeckPlan", "DeckPlan"), ("seaLevel", "sea_level", "SeaLevel", "SeaLevel"), ("GPSTrack", "gps_track", "GpsTrack", "GpsTrack"), ("47", "field_47", "N47", "E47"), ("self", "self_", "Self_", "ESelf"), ("/310", "310", "N310", "E310"), ("port.side", "port_side", "PortSide", "PortSide"), ("", "empty", "Unnamed", "EUnnamed"), ("_", "empty", "Unnamed", "EUnnamed"), ("2-x y", "field_2_x y", "N2XY", "E2XY"), ("loop", "loop_", "Loop", "Loop"), ("naïf", "na_f", "NaF", "NaF")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in NAME_ROWS) + ") v(source, field, type_name, variant)")
def san_golden(spark, sf_dir):
    df = rows(spark, [(r[0],) for r in NAME_ROWS], "source string")
    s = F.col("source")
    return df.select("source", N.field_name(s).alias("field"), N.type_name(s).alias("type_name"), N.variant_name(s).alias("variant"))


@query("SELECT o_orderpriority AS value, 'E' || string_agg(upper(w[1]) || lower(w[2:]), '' ORDER BY i) AS variant FROM (SELECT o_orderpriority, unnest(regexp_split_to_array(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS w, unnest(range(1, 1 + len(regexp_split_to_array(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', ' ', 'g'), ' ')))) AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)) GROUP BY 1")
def san_enum_variant(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")).distinct().select("value", N.variant_name(F.col("value")).alias("variant"))


@query("SELECT * FROM (VALUES (1, 'a', 'A0'), (1, 'A', 'A1'), (1, 'b', 'B'), (2, 'x-y', 'XY0'), (2, 'x y', 'XY1'), (2, 'xY', 'XY2'), (3, 'a', 'A')) v(list, value, variant)")
def san_collision(spark, sf_dir):
    df = rows(spark, [(1, 0, "a"), (1, 1, "A"), (1, 2, "b"), (2, 0, "x-y"), (2, 1, "x y"), (2, 2, "xY"), (3, 0, "a")], "list int, position int, value string")
    return N.variant_names(df, ["list"], "value", "position").select("list", "value", "variant")


@query("SELECT * FROM (VALUES ('', 'a_b,top,x'), ('a_b', 'c'), ('x', 'schema_1,y'), ('x/y', 'z')) v(dir, modules)")
def module_lists(spark, sf_dir):
    df = rows(spark, [("top.rs",), ("a_b/c.rs",), ("x/1.rs",), ("x/y/z.rs",)], "relative string")
    return module_index(df).select("dir", F.array_join("modules", ",").alias("modules"))


@query("SELECT * FROM (VALUES ('a b/1-x.json', 'a_b/_1_x.rs', 'super::super::'), ('n.json', 'n.rs', 'super::')) v(source, path, prefix)")
def output_paths(spark, sf_dir):
    df = rows(spark, [("a b/1-x.json",), ("n.json",)], "source string")
    return df.select("source", N.output_path(F.col("source")).alias("path")).withColumn("prefix", N.import_prefix(F.col("path")))


# Types

TYPED = obj({"o_orderkey": {"type": "integer"}, "o_orderstatus": {"type": "string", "default": "?"}, "o_totalprice": {"type": "number"}, "o_rank": {"type": "integer", "minimum": 0, "maximum": 255, "default": 7}}, required=["o_orderkey"], additionalProperties={"type": "string"})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '?' ELSE o_orderstatus END AS status, o_totalprice AS price, 7::SMALLINT AS rank, o_orderpriority AS priority FROM orders")
def typed_projection_defaults(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    typed = typed_projection(documents_of(df, "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").select("doc"), "doc", TYPED)
    t = F.col("typed")
    return typed.select(t["o_orderkey"].alias("o_orderkey"), t["o_orderstatus"].alias("status"), t["o_totalprice"].alias("price"), t["o_rank"].alias("rank"), t["additional"]["o_orderpriority"].alias("priority"))


def _narrow(low, high) -> str:
    bound = {k: v for k, v in (("minimum", low), ("maximum", high)) if v is not None}
    return numeric_type(Schema.of({"type": "integer", **bound}))[0]


@query("SELECT name, CASE WHEN lo >= 0 THEN CASE WHEN hi <= 255 THEN 'u8' WHEN hi <= 65535 THEN 'u16' WHEN hi <= 4294967295 THEN 'u32' ELSE 'u64' END ELSE 'i64' END AS logical FROM (SELECT 'p_size' AS name, min(p_size) AS lo, max(p_size) AS hi FROM part UNION ALL SELECT 'o_orderkey', min(o_orderkey), max(o_orderkey) FROM orders UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey) FROM customer)")
def type_narrowing(spark, sf_dir):
    found = []
    for name, source in (("p_size", "part"), ("o_orderkey", "orders"), ("c_nationkey", "customer")):
        low, high = table(spark, sf_dir, source).agg(F.min(name), F.max(name)).first()
        found.append((name, _narrow(low, high)))
    return rows(spark, found, "name string, logical string")


BOUNDS = [(0, 255, "u8"), (0, 256, "u16"), (0, 65536, "u32"), (0, 4294967296, "u64"), (-1, 127, "i8"), (-129, 0, "i16"), (-40000, 0, "i32"), (-3000000000, 0, "i64"), (0, None, "i64"), (5, 1, "i64")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {'NULL' if b is None else b}::BIGINT, '{t}')" for a, b, t in BOUNDS) + ") v(lo, hi, logical)")
def type_bounds(spark, sf_dir):
    return rows(spark, [(a, b, _narrow(a, b)) for a, b, _ in BOUNDS], "lo bigint, hi bigint, logical string")


SINK = obj(
    {"byte": {"type": "integer", "minimum": 0, "maximum": 255}, "fixed": {"const": "only"}, "deck-plan": {"type": "string"}, "status": {"enum": ["open", "closed"]}, "tags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True}, "berth": obj({"quay": {"type": "string"}}), "flag": {"type": "boolean"}},
    required=["byte", "status"],
)


@query("SELECT * FROM (VALUES ('Fixed','only','Only','String'), ('Status','closed','Closed','String'), ('Status','open','Open','String'), ('Berth','quay','quay','Option<String>'), ('Root','berth','berth','Option<Berth>'), ('Root','byte','byte','u8'), ('Root','fixed','fixed','Option<Fixed>'), ('Root','flag','flag','Option<bool>'), ('Root','deck-plan','deck_plan','Option<String>'), ('Root','status','status','Status'), ('Root','tags','tags','Option<HashSet<String>>')) v(model, json_key, field_name, logical_type)")
def model_rows_of_schema(spark, sf_dir):
    return rows(spark, model_rows(generate([SINK])), MODEL_ROW).select("model", "json_key", "field_name", "logical_type")


# Corpora of schemas

CORPUS = [
    obj({"id": {"type": "string"}}),
    obj({"id": {"type": "string"}}),
    obj({"id": {"type": "string"}}, description="other"),
    obj({"id": {"type": "integer"}, "in": obj({"id": {"type": "string"}})}),
    {"$defs": {"A": {"type": "string"}}, **obj({"x": {"$ref": "#/$defs/A"}, "y": {"$ref": "#/$defs/B"}, "z": {"$ref": "http://x"}})},
]


def schema_corpus(spark) -> DataFrame:
    return rows(spark, [(i, json.dumps(s)) for i, s in enumerate(CORPUS)], "id int, text string")


@query("SELECT * FROM (VALUES ('Root', 0::BIGINT, 2::BIGINT, true), ('Root', 2, 1, false), ('In', 3, 1, false), ('Root', 3, 1, false)) v(model, first_schema, occurrences, shared)")
def schema_dedupe(spark, sf_dir):
    # The inner `in` of schema 3 equals schemas 0 and 1 but for its title, which counts; here it has none, so it is the same class.
    structs = corpus.struct_rows(schema_corpus(spark).where("id < 4").withColumn("text", F.when(F.col("id") == 3, F.replace(F.col("text"), F.lit('"in": {"type": "object"'), F.lit('"in": {"type": "object", "title": "In"'))).otherwise(F.col("text"))), "id", "text")
    return corpus.dedupe_classes(structs).select("model", "first_schema", "occurrences", "shared")


@query("SELECT * FROM (VALUES ('Root', 0::BIGINT, 4::BIGINT), ('Root', 3, 1)) v(model, first_schema, occurrences)")
def schema_dedupe_functional(spark, sf_dir):
    structs = corpus.struct_rows(schema_corpus(spark).where("id < 4"), "id", "text", MappingSettings(dedupe=DedupeMode.FUNCTIONAL))
    return corpus.dedupe_classes(structs).select("model", "first_schema", "occurrences")


@query("SELECT * FROM (VALUES (0::BIGINT, 2::BIGINT), (2, 1), (3, 1)) v(first_schema, occurrences)")
def schema_classes_full(spark, sf_dir):
    return corpus.schema_classes(schema_corpus(spark).where("id < 4"), "id", "text").select("first_schema", "occurrences")


@query("SELECT * FROM (VALUES (4::BIGINT, '#/$defs/A', 'string', NULL), (4, '#/$defs/B', NULL, 'DefNotFound { ref_str: \"#/$defs/B\", name: \"B\" }'), (4, 'http://x', NULL, 'UnsupportedRef { ref_str: \"http://x\" }')) v(schema_id, ref, target_type, reason)")
def ref_resolution(spark, sf_dir):
    return corpus.resolve_refs(schema_corpus(spark), "id", "text").select("schema_id", "ref", "target_type", "reason")


REFS = [("", "Root", None), ("#", "Root", None), ("#/$defs/Foo", "Defs", "Foo"), ("#/definitions/a~1b", "Definitions", "a/b"), ("x.json", "UnsupportedRef", None), ("#/$defs/A/B", "UnsupportedFragment", None), ("#anchor", "UnsupportedFragment", None), ("#/$defs/a~2", "InvalidPointerEscape", None), ("#/other/A", "UnsupportedFragment", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)})" for a, b, c in REFS) + ") v(ref, kind, name)")
def ref_parsing(spark, sf_dir):
    return rows(spark, [(r[0],) for r in REFS], "ref string").select("ref", R.ref_kind(F.col("ref")).alias("kind"), R.ref_name(F.col("ref")).alias("name"))


URIS = [("https://json-schema.org/draft/2020-12/schema", "DRAFT_2020_12"), (" http://json-schema.org/draft-07/schema# ", "DRAFT_07"), ("http://json-schema.org/schema#", "DRAFT_04"), ("https://json-schema.org/draft/2019-09/schema/", "DRAFT_2019_09"), ("http://json-schema.org/draft-00/hyper-schema#", "DRAFT_00"), ("urn:other", None), ("", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, '{b or 'DRAFT_2020_12'}')" for a, b in URIS) + ") v(uri, version, resolved)")
def spec_version(spark, sf_dir):
    df = rows(spark, [(u,) for u, _ in URIS], "uri string")
    return df.select("uri", R.spec_version(F.col("uri")).alias("version"), R.resolved_spec_version(F.col("uri")).alias("resolved"))


@query("SELECT * FROM (VALUES (0::BIGINT, true), (1, false), (2, false), (3, true)) v(id, parsed)")
def schema_parse_status(spark, sf_dir):
    texts = ['{"type":"object"}', '{"type":"object","unknown":1}', "{", '{"type":["string","null"]}']
    df = rows(spark, list(enumerate(texts)), "id int, text string")
    return corpus.parse_status(df, "id", "text", SchemaSettings(disallow_unknown_fields=True)).select("id", F.col("error").isNull().alias("parsed"))


@query("SELECT * FROM (VALUES (3::BIGINT, 0::BIGINT, NULL::BIGINT, '', 'object'), (3, 1, 0, 'properties/id', 'integer'), (3, 2, 0, 'properties/in', 'object'), (3, 3, 2, 'properties/id', 'string')) v(schema_id, node_id, parent_id, edge, type)")
def schema_node_table(spark, sf_dir):
    return corpus.schema_nodes(schema_corpus(spark).where("id = 3"), "id", "text").select("schema_id", "node_id", "parent_id", "edge", "type")


@query("SELECT * FROM (VALUES ('o_orderkey','integer',true), ('o_custkey','integer',true), ('o_orderstatus','string',false), ('o_totalprice','number',true), ('o_orderdate','string',false), ('o_orderpriority','string',false)) v(key, type, bounded)")
def reverse_schema_fields(spark, sf_dir):
    schema = schema_from_struct(table(spark, sf_dir, "orders").schema)
    return rows(spark, [(k, p.type, p.minimum is not None) for k, p in schema.properties.items()], "key string, type string, bounded boolean")


@query("SELECT count(*) AS n, 0::BIGINT AS n_rejected FROM part")
def reverse_round_trip(spark, sf_dir):
    """A table's own schema accepts all its rows as documents."""
    df = table(spark, sf_dir, "part")
    found = validate_documents(documents_of(df).select("doc"), "doc", schema_from_struct(df.schema))
    return found.agg(F.count("*").alias("n"), F.sum((F.size("errors") > 0).cast("bigint")).alias("n_rejected"))


# Corpora of thousands: one schema a row of a table, built from its columns


def json_text(**parts) -> Column:
    """A JSON object from Columns that hold JSON texts."""
    pieces = []
    for i, (k, v) in enumerate(parts.items()):
        pieces += [F.lit(("," if i else "{") + json.dumps(k) + ":"), v]
    return F.concat(*pieces, F.lit("}"))


def text_of(x) -> Column:
    return F.lit(json.dumps(x))


def all_of(*branches) -> Column:
    return json_text(allOf=F.concat(F.lit("["), F.concat_ws(",", *branches), F.lit("]")))


def string_of(c: str) -> Column:
    return F.concat(F.lit('"'), F.col(c), F.lit('"'))


@query("SELECT p_partkey::BIGINT AS schema_id, CASE WHEN greatest(p_size, 10) <= 30 THEN greatest(p_size, 10)::DOUBLE END AS low, CASE WHEN greatest(p_size, 10) <= 30 THEN 30::DOUBLE END AS high, CASE WHEN greatest(p_size, 10) > 30 THEN 'allOf merge: property \"n\" has conflicting minimum/maximum across subschemas' END AS error FROM part")
def merge_bounds(spark, sf_dir):
    one = json_text(type=text_of("object"), properties=json_text(n=json_text(type=text_of("integer"), minimum=F.col("p_size").cast("string"), maximum=F.lit("60"))))
    two = text_of(obj({"n": {"type": "integer", "minimum": 10, "maximum": 30}}))
    found = corpus.merge_status(table(spark, sf_dir, "part").select("p_partkey", all_of(one, two).alias("t")), "p_partkey", "t")
    at = lambda k: F.get_json_object("merged_json", f"$.properties.n.{k}").cast("double")
    return found.select("schema_id", at("minimum").alias("low"), at("maximum").alias("high"), "error")


@query("SELECT c_custkey::BIGINT AS schema_id, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'second' END AS title, 'object' AS type, 'b,a' || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE ',c' END AS required, 'first' AS comment, 3::INT AS n_properties, NULL AS dropped FROM customer")
def merge_objects(spark, sf_dir):
    title = F.when(F.col("c_nationkey") % 2 == 0, string_of("c_mktsegment")).otherwise(F.lit('"  "'))
    one = json_text(title=title, required=F.lit('["b","a"]'), properties=text_of({"a": {"type": "string"}, "b": {"type": "string"}}), **{"$id": F.lit('"gone"')})
    more = F.when(F.col("c_nationkey") % 3 == 0, F.lit('["a"]')).otherwise(F.lit('["a","c"]'))
    two = json_text(title=F.lit('"second"'), type=F.lit('"object"'), required=more, properties=text_of({"c": {"type": "boolean"}, "a": {"type": "string"}}), **{"$comment": F.lit('"first"')})
    found = corpus.merge_status(table(spark, sf_dir, "customer").select("c_custkey", all_of(one, two).alias("t")), "c_custkey", "t")
    m = lambda k: F.get_json_object("merged_json", f"$['{k}']")
    return found.select("schema_id", m("title").alias("title"), m("type").alias("type"), F.array_join(F.from_json(m("required"), "array<string>"), ",").alias("required"), m("$comment").alias("comment"), F.size(F.json_object_keys(m("properties"))).alias("n_properties"), m("$id").alias("dropped"))


@query("SELECT o_orderkey::BIGINT AS schema_id, CASE WHEN o_orderkey % 4 = 0 THEN 'conflicting types in subschemas at indices []' WHEN o_orderkey % 4 = 1 AND o_orderstatus <> 'F' THEN 'conflicting const values across subschemas' WHEN o_orderkey % 4 = 2 AND o_orderpriority <> '1-URGENT' THEN 'conflicting pattern across subschemas' END AS error, CASE WHEN o_orderkey % 4 = 3 THEN 5::BIGINT END AS min_items FROM orders")
def merge_properties(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    one = F.when(k == 0, F.lit('{"type":"string"}')).when(k == 1, json_text(type=F.lit('"string"'), const=string_of("o_orderstatus"))).when(k == 2, json_text(type=F.lit('"string"'), pattern=string_of("o_orderpriority"))).otherwise(text_of({"type": "array", "minItems": 5, "items": {"type": "integer", "minimum": 1}}))
    two = F.when(k == 0, F.lit('{"type":"integer"}')).when(k == 1, F.lit('{"type":"string","const":"F"}')).when(k == 2, F.lit('{"type":"string","pattern":"1-URGENT"}')).otherwise(text_of({"type": "array", "minItems": 9, "items": {"type": "integer", "maximum": 4}}))
    whole = lambda p: json_text(type=F.lit('"object"'), properties=json_text(x=p))
    found = corpus.merge_status(table(spark, sf_dir, "orders").select("o_orderkey", all_of(whole(one), whole(two)).alias("t")), "o_orderkey", "t")
    return found.select("schema_id", F.regexp_extract("error", 'has (.*)$', 1).alias("error"), F.get_json_object("merged_json", "$.properties.x.minItems").cast("bigint").alias("min_items")).withColumn("error", F.nullif(F.col("error"), F.lit("")))


MERGE_ERRORS = [({"allOf": []}, "allOf is present but empty (no subschemas to merge)"), ({"allOf": [{"type": "string"}]}, 'allOf subschema at index 0 is not object-like (need type "object" or non-empty properties)'), ({"allOf": [obj({"a": {}}), {"title": "x"}]}, 'allOf subschema at index 1 is not object-like (need type "object" or non-empty properties)'), ({"type": "object"}, None), ({"allOf": [obj({"a": {"enum": ["p"]}}), obj({"a": {"enum": ["q"]}})]}, 'allOf merge: property "a" has conflicting enum values across subschemas')]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {'NULL' if e is None else repr(e) if chr(39) not in e else e})" for i, (_, e) in enumerate(MERGE_ERRORS)) + ") v(schema_id, error)")
def merge_errors(spark, sf_dir):
    df = rows(spark, [(i, json.dumps(s)) for i, (s, _) in enumerate(MERGE_ERRORS)], "id int, t string")
    return corpus.merge_status(df, "id", "t").select("schema_id", "error")


NARROW_SQL = "CASE WHEN {0} <= 255 THEN 'u8' WHEN {0} <= 65535 THEN 'u16' ELSE 'u32' END"


@query("SELECT p_partkey::BIGINT AS schema_id, w || CASE WHEN p_partkey % 2 = 0 THEN 'AnyOf' ELSE 'OneOf' END AS model, 'union' AS kind, v AS json_key, CASE WHEN v = 'Variant0' THEN 'String' WHEN v = 'Variant1' THEN " + NARROW_SQL.format("p_partkey * 40") + " ELSE w || 'Variant2' END AS logical_type FROM part, (VALUES ('Variant0'), ('Variant1'), ('Variant2')) x(v), (VALUES ('Load')) y(w)")
def gen_unions(spark, sf_dir):
    """Unions of a property: one model with a variant a branch, branches of objects named by their place."""
    branches = F.concat(F.lit('[{"type":"string"},{"type":"integer","minimum":0,"maximum":'), (F.col("p_partkey") * 40).cast("string"), F.lit('},{"type":"object","properties":{"z":{"type":"boolean"}}}]'))
    even = F.col("p_partkey") % 2 == 0
    prop = F.when(even, json_text(anyOf=branches)).otherwise(json_text(oneOf=branches))
    df = table(spark, sf_dir, "part").select("p_partkey", json_text(type=text_of("object"), properties=json_text(load=prop)).alias("t"))
    return corpus.model_table(df, "p_partkey", "t").where("kind = 'union'").select("schema_id", "model", "kind", "json_key", "logical_type")


@query("SELECT s_suppkey::BIGINT AS schema_id, 'Root' AS model, k AS json_key, t AS logical_type FROM supplier, LATERAL (SELECT * FROM (VALUES ('head', 'Option<Berth>'), ('ids', 'Option<HashSet<String>>'), ('legs', 'Option<Vec<Berth>>'), ('low', 'Option<u8>')) v(k, t)) UNION ALL SELECT s_suppkey, 'Berth', 'name', 'Option<String>' FROM supplier")
def gen_refs(spark, sf_dir):
    """References give a model the definition's name; sets are hashed only over what can be."""
    one = json_text(type=text_of("object"), properties=json_text(name=F.lit('{"type":"string"}')))
    schema = json_text(**{"$defs": json_text(berth=one, low=F.lit('{"type":"integer","minimum":0,"maximum":9}'))}, type=text_of("object"), properties=text_of({"head": {"$ref": "#/$defs/berth"}, "legs": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/berth"}}, "ids": {"type": "array", "uniqueItems": True, "items": {"type": "string"}}, "low": {"$ref": "#/$defs/low"}}))
    df = table(spark, sf_dir, "supplier").select("s_suppkey", schema.alias("t"))
    return corpus.model_table(df, "s_suppkey", "t").select("schema_id", "model", "json_key", "logical_type")


@query("SELECT n_nationkey::BIGINT AS schema_id, 'x' AS json_key, n_name || chr(10) || '# Examples' || chr(10) || '\"a\"' || chr(10) || '1' AS docs, n_nationkey % 2 = 0 AS deprecated, '{\"max_length\":' || (n_nationkey + 1) || ',\"pattern\":\"^a\"}' AS attrs, '\"d\"' AS default_json, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'Inner' END AS title FROM nation")
def gen_docs(spark, sf_dir):
    """Docs, deprecation, attributes and defaults of a field, and a model's title, in both orders of naming."""
    prop = json_text(type=text_of("string"), description=F.concat(F.lit('"  '), F.col("n_name"), F.lit(' \\n \\n"')), examples=F.lit('["a",1]'), deprecated=F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"), maxLength=(F.col("n_nationkey") + 1).cast("string"), pattern=text_of("^a"), default=text_of("d"))
    inner = json_text(type=text_of("object"), title=string_of("n_name"), properties=json_text(x=prop))
    df = table(spark, sf_dir, "nation").select("n_nationkey", json_text(type=text_of("object"), properties=json_text(inner=inner)).alias("t"))
    by_key = corpus.model_table(df, "n_nationkey", "t", MappingSettings(name_source=NameSource.PROPERTY_KEY_FIRST)).where("model = 'Inner'")
    title = F.when(F.col("schema_id") % 3 == 0, F.col("n_name")).otherwise(F.col("model"))
    names_ = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("schema_id"), "n_name")
    return by_key.join(names_, "schema_id").select("schema_id", "json_key", "docs", "deprecated", "attrs", "default_json", title.alias("title"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'Even' ELSE 'Odd' END AS model, min(p_partkey)::BIGINT AS first_schema, count(*) AS occurrences, count(*) > 1 AS shared FROM part GROUP BY p_size, 1")
def dedupe_corpus(spark, sf_dir):
    """A corpus of one schema a part: those that are equal but for ids of their own are found by key, whatever a class's share."""
    title = F.when(F.col("p_size") % 2 == 0, "Even").otherwise("Odd")
    schema = json_text(**{"$id": string_of("p_name")}, title=F.concat(F.lit('"'), title, F.lit('"')), type=text_of("object"), properties=json_text(a=json_text(type=text_of("string"), maxLength=F.col("p_size").cast("string"))))
    structs = corpus.struct_rows(table(spark, sf_dir, "part").select("p_partkey", schema.alias("t")), "p_partkey", "t", MappingSettings(dedupe=DedupeMode.FUNCTIONAL))
    return corpus.dedupe_classes(structs).select("model", "first_schema", "occurrences", "shared")


SHARED = [obj({"leg": obj({"port": obj({"city": {"type": "string"}})}), "own": obj({"n": {"type": "integer"}})}, title="Trip"), obj({"leg": obj({"port": obj({"city": {"type": "string"}})})}, title="Tour"), obj({"list": {"type": "array", "items": obj({"city": {"type": "string"}}, title="Port")}}, title="Ports")]


@query("SELECT * FROM (VALUES ('Port', 'shared', 0, ''), ('Leg', 'shared', 1, ''), ('Own', 'schema', 0, 'Port,Leg'), ('Trip', 'schema', 1, 'Port,Leg'), ('Tour', 'schema', 0, 'Port,Leg'), ('Port', 'schema', 0, ''), ('Ports', 'schema', 1, '')) v(model, place, ord, exports)")
def dedupe_shared(spark, sf_dir):
    """Shared models, what they are made of first; each schema's own models and the shared ones that it takes (a title counts, so the titled Port stands apart)."""
    made = generate(SHARED)
    return rows(spark, [(m.name, "shared" if shared else "schema", j, "" if shared else ",".join(made.exports[i])) for i, j, m, shared in made.rows], "model string, place string, ord int, exports string")


@query("SELECT * FROM (VALUES (0, 'Port', 'city STRING'), (1, 'Leg', 'port STRUCT<city: STRING>')) v(ord, model, ddl)")
def dedupe_shared_ddl(spark, sf_dir):
    return rows(spark, [(i, m.name, ddl_of(struct_of_model(m))) for i, m in enumerate(generate(SHARED).shared)], "ord int, model string, ddl string")


@query("SELECT key_order::INT AS key_order, id::BIGINT AS schema_id FROM (VALUES (0, 1), (1, 2), (2, 0)) v(key_order, id)")
def dedupe_order(spark, sf_dir):
    """Keys are ordered as texts."""
    from .plans.dedupe import dedupe_key

    schemas = [obj({"b": {"type": "string"}}), obj({"a": {"type": "integer"}}), obj({"a": {"type": "string"}})]
    order = sorted(range(3), key=lambda i: dedupe_key(Schema.of(schemas[i])))
    return rows(spark, list(enumerate(order)), "key_order int, schema_id bigint")


def reverse_type():
    from pyspark.sql import types as T

    inner = T.StructType([T.StructField("x", T.LongType())])
    return T.StructType(
        [
            T.StructField("flags", T.ArrayType(T.BooleanType()), False, {"unique_items": True}),
            T.StructField("list", T.ArrayType(T.StringType())),
            T.StructField("map", T.MapType(T.StringType(), T.ShortType())),
            T.StructField("id", T.StringType(), False, {"format": "uuid"}),
            T.StructField("one", T.StringType(), True, {"enum": ["only"]}),
            T.StructField("many", T.StringType(), True, {"enum": ["p", "q"]}),
            T.StructField("inner", inner),
            T.StructField("byte", T.ShortType(), True, {"logical": "Option<u8>"}),
            T.StructField("real", T.FloatType()),
            T.StructField("old", T.StringType(), True, {"rename": "renamed", "min_length": 2, "max_length": 4, "pattern": "^a", "deprecated": True, "default": "ab", "title": "T", "description": "D", "comment": "C"}),
            T.StructField("n", T.IntegerType(), True, {"minimum": 3, "maximum": 7}),
        ]
    )


@query("SELECT * FROM (VALUES ('flags', 'array', NULL::DOUBLE, NULL::DOUBLE, 'unique boolean', true), ('list', 'array', NULL, NULL, 'string', false), ('map', 'object', NULL, NULL, '-32768..32767', false), ('id', 'string', NULL, NULL, 'uuid', true), ('one', NULL, NULL, NULL, 'const only', false), ('many', NULL, NULL, NULL, 'enum p,q', false), ('inner', NULL, NULL, NULL, '#/$defs/Inner', false), ('byte', 'integer', 0, 255, '', false), ('real', 'number', -3.4028234663852886e38, 3.4028234663852886e38, '', false), ('renamed', 'string', NULL, NULL, '2,4,^a,true,ab,T,D,C', false), ('n', 'integer', 3, 7, '', false)) v(key, type, low, high, detail, required)")
def reverse_types(spark, sf_dir):
    schema = schema_from_struct(reverse_type())

    def detail(p: Schema) -> str:
        if p.min_length is not None:
            return f"{p.min_length},{p.max_length},{p.pattern},{str(p.deprecated).lower()},{p.default},{p.title},{p.description},{p.comment}"
        if p.items is not None:
            return ("unique " if p.unique_items else "") + p.items.type
        if isinstance(p.additional_properties, Schema):
            return f"{p.additional_properties.minimum:.0f}..{p.additional_properties.maximum:.0f}"
        return f"const {p.const}" if p.const is not None else f"enum {','.join(p.enum)}" if p.enum else p.ref or p.format or ""

    return rows(spark, [(k, p.type, p.minimum, p.maximum, detail(p), schema.is_required(k)) for k, p in schema.properties.items()], "key string, type string, low double, high double, detail string, required boolean")


@query("SELECT * FROM (VALUES ('$schema', 'https://json-schema.org/draft/2020-12/schema'), ('$id', 'urn:x'), ('title', 'T'), ('description', 'D'), ('$comment', 'C'), ('additionalProperties', 'false'), ('$defs', 'Inner')) v(word, value)")
def reverse_container(spark, sf_dir):
    made = schema_from_struct(reverse_type(), title="T", id="urn:x", description="D", comment="C").to_dict()
    shown = {k: ",".join(v) if isinstance(v, dict) else json.dumps(v) if isinstance(v, bool) else v for k, v in made.items() if k not in ("type", "properties", "required")}
    return rows(spark, list(shown.items()), "word string, value string")


@query("SELECT * FROM (VALUES ('X', 'string', 0), ('Y', NULL, 0), ('Z', 'boolean', 0)) v(name, type, nested)")
def reverse_hoist(spark, sf_dir):
    """Definitions of nested schemas move to the root; of one name the first met stays."""
    made = hoist_defs(Schema.of(obj({"a": obj({}, **{"$defs": {"X": {"type": "string"}}})}, **{"$defs": {"Y": {"$defs": {"X": {"type": "integer"}, "Z": {"type": "boolean"}}}}})))
    return rows(spark, [(k, v.type, len(v.defs or {})) for k, v in made.defs.items()], "name string, type string, nested int")


@query("SELECT * FROM (VALUES ('schema_0', 'a:string'), ('schema_1', 'n:bigint')) v(name, kind)")
def struct_types_of_several(spark, sf_dir):
    found = struct_types(json.dumps(obj({"a": {"type": "string"}})), obj({"n": {"type": "integer"}}))
    return rows(spark, [(k, v.simpleString()[7:-1]) for k, v in found.items()], "name string, kind string")


@query("SELECT * FROM (VALUES ('bytes'), ('file'), ('object'), ('schema'), ('text')) v(source), (VALUES ('{\"type\":\"object\",\"required\":[\"a\"]}')) w(text)")
def schema_sources(spark, sf_dir):
    """One schema from every kind of source."""
    import io

    text = '{"required": ["a"], "type": "object", "unknown": 1}'
    kinds = {"text": text, "bytes": text.encode(), "object": json.loads(text), "file": io.BytesIO(text.encode()), "schema": Schema.of(text)}
    return rows(spark, [(k, Schema.of(v, SchemaSettings()).to_json()) for k, v in kinds.items()], "source string, text string")


@query("SELECT o_orderkey::BIGINT AS id, '{\"type\":\"object\",\"properties\":{\"k\":{\"enum\":[\"' || o_orderstatus || '\"],\"minimum\":' || o_shippriority || '.0}},\"required\":[\"k\"],\"anyOf\":[]}' AS schema_json FROM (SELECT *, o_orderkey % 7 AS o_shippriority FROM orders)")
def schema_text(spark, sf_dir):
    """Schemas as text, keywords in the model's order, an empty anyOf kept."""
    prop = json_text(enum=F.concat(F.lit('["'), F.col("o_orderstatus"), F.lit('"]')), minimum=(F.col("o_orderkey") % 7).cast("string"))
    schema = json_text(anyOf=F.lit("[]"), required=F.lit('["k"]'), properties=json_text(k=prop), type=text_of("object"), other=F.lit("1"))
    return corpus.parse_status(table(spark, sf_dir, "orders").select("o_orderkey", schema.alias("t")), "o_orderkey", "t").select("id", "schema_json")


@query("SELECT * FROM (VALUES ('a_b/__init__', 'from . import c'), ('__init__', 'from . import a_b,from . import shared,from . import top'), ('a_b/c', 'from ..shared import Port'), ('top', 'from .shared import Port')) v(file, lines)")
def output_files(spark, sf_dir):
    """What generate writes: mirrored places, shared models reached by depth, an index a folder."""
    import tempfile
    from pathlib import Path

    from .plans.models import StructTypeBackend
    from .sources.scan import write_models

    port = obj({"city": {"type": "string"}}, title="Port")
    with tempfile.TemporaryDirectory() as folder:
        paths = write_models([obj({"p": port}, title="A"), obj({"q": port}, title="B")], StructTypeBackend(), folder, relatives=["top.json", "a b/c.json"])
        texts = {str(Path(p).relative_to(folder).with_suffix("")): Path(p).read_text().splitlines() for p in paths}
    return rows(spark, [(k, ",".join(x for x in v if x.startswith("from .") or x.startswith("from . "))) for k, v in texts.items() if k != "shared"], "file string, lines string")
