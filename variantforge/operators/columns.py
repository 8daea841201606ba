"""Columns of any names: exact references, names that clash with none, and Arrow functions over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: list[str], stem: str = "__v") -> str:
    """A prefix that no name in taken begins with, whatever its case."""
    while any(c.lower().startswith(stem) for c in taken):
        stem += "_"
    return stem


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    """schema with the fields of a DDL string put behind its own."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(fields).fields])


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow for columns of any names: run sees and gives columns by place, the result has the names of schema."""
    names = [f"c{i}" for i in range(len(schema.fields))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(placed, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields, strict=True)])).toDF(*schema.names)
