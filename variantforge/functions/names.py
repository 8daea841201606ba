"""Names from text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.names import RESERVED


def ascii_only(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "_")


def _split_case(s: Column) -> Column:
    s = F.regexp_replace(s, r"([a-z][0-9]*)(?=[A-Z])", "$1_")
    return F.regexp_replace(s, r"([A-Z][0-9]*)(?=[A-Z][a-z])", "$1_")


def _starts_with_digit(s: Column) -> Column:
    return s.rlike(r"^[0-9]")


def snake_case(s: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(_split_case(s), "[^A-Za-z0-9]+", "_"), F.lit("_")))


def pascal_case(s: Column) -> Column:
    parts = F.filter(F.split(_split_case(ascii_only(s)), "[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    return F.when(joined == "", "Unnamed").when(_starts_with_digit(joined), F.concat(F.lit("N"), joined)).otherwise(joined)


def field_name(key: Column) -> Column:
    s = F.replace(ascii_only(key), F.lit("-"), F.lit("_"))
    clean = F.regexp_replace(s, "[^A-Za-z0-9_]", "_")
    snake = snake_case(clean)
    named = F.when(snake.isin(*sorted(RESERVED)), F.concat(snake, F.lit("_"))).otherwise(snake)
    return F.when(s == "", "empty").when(_starts_with_digit(s), F.concat(F.lit("field_"), s)).when(clean == "_", "empty").otherwise(named)


def type_name(s: Column) -> Column:
    pascal = pascal_case(s)
    return F.when(pascal == "Self", "Self_").otherwise(pascal)


def variant_name(value: Column) -> Column:
    s = F.btrim(F.regexp_replace(ascii_only(value), "[^A-Za-z0-9 -]+", "_"), F.lit("_"))
    pascal = pascal_case(s)
    named = F.when(_starts_with_digit(s), F.concat(F.lit("E"), F.regexp_replace(pascal, "^N", ""))).when(pascal == "Self", "ESelf").otherwise(pascal)
    return F.when(s == "", "EUnnamed").otherwise(named)


def variant_names(values: DataFrame, group: list[str], value: str, position: str) -> DataFrame:
    """values with `variant`: names that collide within a group all get their index by position."""
    named = values.withColumn("__base", variant_name(F.col(value)))
    same = Window.partitionBy(*group, "__base")
    index = F.row_number().over(same.orderBy(position)) - 1
    many = F.count("*").over(same) > 1
    return named.withColumn("variant", F.when(many, F.concat("__base", index.cast("string"))).otherwise(F.col("__base"))).drop("__base")


def path_component(s: Column) -> Column:
    clean = F.regexp_replace(s, "[^A-Za-z0-9_]", "_")
    return F.when(clean == "", "schema").when(_starts_with_digit(clean), F.concat(F.lit("_"), clean)).otherwise(clean)


def output_path(relative: Column, suffix: str = ".rs") -> Column:
    """Every component made safe; the last one's extension becomes suffix."""
    parts = F.filter(F.split(relative, "/"), lambda p: ~p.isin("", "."))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), path_component)
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(F.concat(folders, F.array(F.concat(path_component(stem), F.lit(suffix)))), "/"))


def module_name(s: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(ascii_only(s), "[-. ]", "_"), "[^A-Za-z0-9_]", "")
    named = F.when(_starts_with_digit(clean), F.concat(F.lit("schema_"), clean)).when(clean.isin("crate", "self", "super"), F.concat(clean, F.lit("_mod")))
    return F.when(clean == "", "schema").otherwise(F.coalesce(named, clean))


def module_of_path(path: Column) -> Column:
    return module_name(F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", ""))


def import_prefix(relative: Column) -> Column:
    """`super::` for each folder above an output file, and one more."""
    return F.repeat(F.lit("super::"), F.size(F.filter(F.split(relative, "/"), lambda p: p != "")))
