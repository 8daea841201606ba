"""SQL access: a table function of errors, and functions registered under SQL names."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.interpret import check_terminates, validate
from ..plans.errors import ERROR_FIELDS, ERROR_TYPE, message
from ..plans.schema import Schema
from ..plans.values import InvalidJson, parse_json


@lru_cache(maxsize=64)
def _schema(text: str) -> Schema:
    schema = Schema.of(text)
    check_terminates(schema)
    return schema


class JsonSchemaErrors:
    """One row per error of doc under schema, in order; none for null or text that is not JSON."""

    def eval(self, doc: str, schema: str):
        if doc is None or schema is None:
            return
        try:
            value = parse_json(doc, max_depth=None)
        except InvalidJson:
            return
        for i, e in enumerate(validate(_schema(schema), value)):
            yield (i, *(e[f] for f in ERROR_FIELDS), message(e))


def register(spark: SparkSession) -> None:
    """Registers json_schema_errors(doc, schema), for use with LATERAL."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ERROR_TYPE)
    spark.udtf.register("json_schema_errors", udtf(JsonSchemaErrors, returnType=f"ord int, {fields}, message string"))
