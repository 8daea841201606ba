"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, licences, pieces, pseudonyms, quality, token_counts, url_filter
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .parity_join import parity_join
from .scratch import Scratch, bounded


#: The key of the registered query; a deployment passes its own secret.
PSEUDONYM_KEY = b"registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of an integer key as text, modulo parts."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.private(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the pieces and whether they decode to the text; null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = pieces.encode(docs, check=True)
    return found.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_crc")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs, held_out)
    found = language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "quality").cut(quality.features(table(spark, sf_dir, "documents")), "features")
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", "quality")
    model = quality.fit(rows.join(labels, "doc_id"), "quality")
    scored = rows.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), quality.score(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after a title line is put first and runs of digits or symbols are masked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.recount(token_counts.masking_edits(docs, head="# Document\n"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, _ = url_filter.url_parts(F.col("url"))
    labelled = pages.select("url", url_filter.seed_label(host).alias("label"))
    return url_filter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: bounded(f)
    for f in (
        op1_decontamination,
        op2_pseudonyms,
        op3_sentencepiece,
        op4_exact_dedup,
        op5_ngram_jaccard_join,
        op6_language_id,
        op7_licence_scan,
        op8_quality_classifier,
        op9_token_counts,
        op10_url_filter,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS rk,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, rk = 1 AS kept, sha256(norm) AS text_sha256 FROM r
""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id,
         CASE WHEN len(ws) >= 3
              THEN list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])
              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
              ELSE [] END AS sh
  FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p WHERE 100 * shared >= 90 * (na + nb - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT r.a, l.y FROM r JOIN l ON r.b = l.x
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, c.component_id FROM s JOIN c ON c.a = s.doc_id
""",
}
