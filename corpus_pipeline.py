"""The corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, all columns; the last returns the
encoded documents.  Stages are judged, and work, on the rows that the stage before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantforge.llm import language_id, pieces
from variantforge.llm.decontaminate import drop_leaks
from variantforge.llm.exact_dedup import exact_dedup
from variantforge.llm.parity_join import parity_join
from variantforge.llm.scratch import Scratch, bounded
from variantforge.operators.columns import named

#: Near copies share this much of their sets of shingles of so many words.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 8, 10


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those that lie about as near to a second language's codeword (`ambiguous`).

    Without any labelled text there is nothing to learn from, and only documents without letters go.
    """
    model = language_id.train(docs, F.lit(False))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    aside = {c: f"{c}__{len(docs.columns)}" for c in docs.columns if c in ("lang_pred", "score", "ambiguous")}
    found = language_id.identify(docs.withColumnsRenamed(aside), model)
    kept = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.select(*[named(aside.get(c, c)).alias(c) for c in docs.columns])


def _repeated(docs: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not docs.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty()


@bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the owner of each group of equal texts: one row, also of rows repeated with one doc_id."""
    scratch = Scratch(spark, "copies")
    owners = scratch.cut(exact_dedup(docs, scratch=scratch).where("kept").select("doc_id", "text_crc"), "kept")
    scratch.drop_all_but("kept")
    scratch.tidy()
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(owners, docs["doc_id"].eqNullSafe(owners["doc_id"]) & (crc == owners["text_crc"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if _repeated(docs) else kept


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id in each component of linked documents; rows without doc_id stay.

    Where a doc_id occurs twice, different texts under it are judged by row numbers in order of doc_id.
    """
    rows, key = docs.where("doc_id IS NOT NULL"), "doc_id"
    if _repeated(docs):
        key = f"row__{len(docs.columns)}"
        ordered = rows.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text")
        rows = Scratch(spark, "near_copies").cut(ordered.withColumn(key, F.monotonically_increasing_id()), "rows")
    joined = parity_join(rows, k=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN, id_col=key)
    least = joined.where("component_id = doc_id").select(F.col("doc_id").alias(key))
    kept = rows.join(least, key, "left_semi").select(*[named(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id IS NULL"))


@bounded
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, their number and whether they decode to the text; a null text counts as empty."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pieces.encode(texts, check=True)
    return found.select("doc_id", "pieces", F.size("pieces").cast("bigint").alias("n_pieces"), "lossless")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: Language ID, edit budgets and merge-dropout have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
