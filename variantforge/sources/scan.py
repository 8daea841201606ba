"""Reading schemas and documents, writing schemas and models."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import module_of_path
from ..plans import names
from ..plans.models import MappingSettings, ModelBackend


class MissingInput(FileNotFoundError):
    pass


def _require(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise MissingInput(f"no such file or folder: {path}")


def read_schema_files(spark: SparkSession, *inputs: str) -> DataFrame:
    """(file_path, text) of files, and of all `*.json` files below folders; a file named twice counts once.

    Raises MissingInput for a path that is not there.
    """
    found = None
    for path in inputs:
        _require(spark, path)
        reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        is_file = PurePosixPath(path).suffix != "" and spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile()
        rows = (reader if is_file else reader.option("pathGlobFilter", "*.json")).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise MissingInput("no input")
    return found.dropDuplicates(["file_path"])


def read_documents(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One VARIANT document a line of JSON."""
    _require(spark, path)
    return spark.read.option("singleVariantColumn", column).json(path)


def read_document_text(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, doc): one document a file, as text."""
    _require(spark, path)
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("doc"))


def documents_of(df: DataFrame, *columns: str, doc: str = "doc") -> DataFrame:
    """df with its columns (all, or those named) as one JSON document; nulls are left out of it."""
    return df.withColumn(doc, F.to_json(F.struct(*(columns or df.columns))))


def module_index(files: DataFrame, path_col: str = "relative") -> DataFrame:
    """(dir, modules): the sorted child modules of each folder of output files, subfolders among them."""
    folders = F.filter(F.split(F.col(path_col), "/"), lambda p: p != "")
    depth = F.size(folders)
    up = F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.struct(F.array_join(F.slice(folders, 1, n - 1), "/").alias("dir"), F.element_at(folders, n).alias("child"))))
    rows = files.where(depth > 0).select(up.alias("x")).select("x.dir", module_of_path(F.col("x.child")).alias("module"))
    return rows.groupBy("dir").agg(F.array_sort(F.collect_set("module")).alias("modules"))


def module_lists(relatives: list[str]) -> dict[str, list[str]]:
    """``module_index`` of a few paths, without Spark: folder -> sorted child modules."""
    found: dict[str, set[str]] = {}
    for relative in relatives:
        parts = [p for p in relative.split("/") if p]
        for n in range(len(parts)):
            found.setdefault("/".join(parts[:n]), set()).add(names.module_of_path(parts[n]))
    return {folder: sorted(modules) for folder, modules in sorted(found.items())}


def write_models(schemas: list, backend: ModelBackend, folder: str, settings: MappingSettings = MappingSettings(), relatives: list[str] | None = None) -> list[str]:
    """Writes the generated files of a batch of schemas below a folder and returns their paths.

    relatives: where each schema's file goes, by the path of its source below its input; `schema_{i}` without.
    Every component is made safe.  Shared models go to `shared` at the top, to which the files below refer by
    their depth, and each folder gets an index of its modules.
    """
    import os

    made = backend.generate(schemas, settings)
    places = [names.output_path(r, backend.suffix) for r in relatives or [f"schema_{i}" for i in range(len(schemas))]]
    if len(set(places)) < len(places):
        raise ValueError("two schemas would be written to one file: " + ", ".join(sorted({p for p in places if places.count(p) > 1})))
    texts = {place: backend.placed(made.get(f"schema_{i}", ""), place.count("/")) for i, place in enumerate(places)}
    if "shared" in made:
        texts[f"shared{backend.suffix}"] = made["shared"]
    for where, modules in module_lists(list(texts)).items():
        texts[f"{where}/{backend.index_name}{backend.suffix}".lstrip("/")] = backend.index(modules)
    for place, text in sorted(texts.items()):
        path = os.path.join(folder, *place.split("/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return [os.path.join(folder, *place.split("/")) for place in sorted(texts)]
