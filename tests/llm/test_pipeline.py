"""The pipeline's stages against brute force on a small fixture, and the registered queries' shapes."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from variantforge.llm import language_id
from variantforge.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import brute_exact, brute_join
from .test_texts import prose


@pytest.fixture(scope="module")
def world(spark, docs, tmp_path_factory):
    r = random.Random(8)
    item = prose(r, 30)
    texts = [(i, prose(r, 60), "en") for i in range(20)]
    texts += [(20, texts[3][1].replace(" ", "  "), "en"), (21, texts[4][1] + " tail", "en"), (22, prose(r, 20) + " " + item + " " + prose(r, 20), "en"), (23, "12 34", "en"), (24, None, "en"), (25, "", None), (5, texts[5][1], "en"), (None, prose(r, 40), None)]
    folder = tmp_path_factory.mktemp("sf")
    docs(texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts


def test_stages(spark, world):
    folder, texts = world
    got = corpus_pipeline.run(spark, folder).collect()
    rows = [t[:2] for t in texts if t[1] and any(c.isalpha() for c in t[1])]
    keep = {k for k, _ in brute_exact(rows).values()}
    rows = [x for x in dict.fromkeys(rows) if x[0] in keep]
    roots = brute_join([x for x in rows if x[0] is not None])
    rows = [x for x in rows if x[0] is None or roots[x[0]][1] == x[0]]
    rows = [x for x in rows if x[0] != 22]
    assert sorted(str(g["doc_id"]) for g in got) == sorted(str(x[0]) for x in rows)
    assert all(g["lossless"] and g["n_pieces"] == len(g["pieces"]) for g in got)
    assert {20, 4} & {g["doc_id"] for g in got} == {20, 4} and 3 not in {g["doc_id"] for g in got}


def test_stage_columns_and_empty_tables(spark, world, docs):
    folder, _ = world
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        for rows in ([], [(1, "some words here", "en"), (1, None, None)]):
            out = stage(spark, docs(rows), folder)
            assert name == "sentencepiece" or out.columns == docs([]).columns
            assert out.count() <= len(rows)


def test_columns_of_clashing_names_stay(spark, world, docs):
    """Columns named like the operators' own pass all stages with their values and places."""
    folder, texts = world
    own = docs([t for t in texts if t[0] not in (24, 25)]).withColumnsRenamed({"row": "lang_pred"}).withColumn("ambiguous", F.lit("kept")).withColumn("text_crc", F.lit(7)).withColumn("sha", F.lit("s")).withColumn("leaked_sha", F.lit("l")).withColumn("component_id", F.lit(3)).withColumn("a b.c", F.lit(4))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, folder)
        assert out.columns == own.columns and out.dtypes == own.dtypes, name
        rows = out.collect()
        assert rows and all((r["lang_pred"], r["ambiguous"], r["text_crc"], r["sha"], r["component_id"], r["a b.c"], r["score"]) == ("r", "kept", 7, "s", 3, 4, "s") for r in rows), name


def test_texts_between_two_languages_are_rejected(spark, docs, monkeypatch):
    r = random.Random(3)
    words = {"x": "abcdefg", "y": "tuvwxyz"}
    rows = [(i, " ".join("".join(r.choice(words[lang]) for _ in range(5)) for _ in range(40)), lang) for i, lang in enumerate(["x", "y"] * 40)]
    kept = {g["doc_id"] for g in corpus_pipeline.identify_language(spark, docs([*rows, (510, "!!! 123", "x")]), "").collect()}
    assert kept == {i for i, _, _ in rows}
    code = language_id.codewords(3)
    bits = code.shape[1]
    unsure = language_id.EcocModel(("x", "y", "z"), code, np.zeros((language_id.DIMS, bits), np.float32), np.zeros(bits, np.float32), np.full(bits, 1 / bits))
    monkeypatch.setattr(language_id, "train", lambda *_: unsure)
    assert corpus_pipeline.identify_language(spark, docs(rows), "").count() == 0


def test_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for i in range(1, 11) for n in QUERIES if n.startswith(f"op{i}_")]
    assert ORACLE_SQL.keys() <= QUERIES.keys()
