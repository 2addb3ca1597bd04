"""Toxicity in the pipeline: rows are kept by the score beside them, texts are not shuffled."""

import contextlib
import io

import corpus_pipeline

from pyspark.sql import functions as F

from modelshift.llm.toxicity import score_toxicity


def test_texts_stay_where_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        corpus_pipeline.drop_toxic(spark, docs, sf_dir).explain()
    assert "Exchange" not in shown.getvalue()


def test_carried_columns_are_those_of_the_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
        "text", F.when(F.col("doc_id") % 7 > 0, F.col("text")))  # every seventh is null
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score_toxicity(docs, labels, carry=tuple(docs.columns))
    rows = got.select("row.*")
    assert rows.columns == docs.columns
    assert rows.exceptAll(docs).count() == 0 and docs.exceptAll(rows).count() == 0
    text = F.coalesce(F.col("row.text"), F.lit(""))
    assert got.where((F.col("id") != F.col("row.doc_id")) | (F.col("text_hash") != F.xxhash64(text))).count() == 0
    plain = {(r["id"], r["text_hash"]): r["score"] for r in score_toxicity(docs, labels).collect()}
    for r in got.select("id", "text_hash", "score").collect():
        assert abs(plain[r["id"], r["text_hash"]] - r["score"]) < 1e-9
    some = score_toxicity(docs, labels, carry=("lang", "n_chars")).select("id", "row.*")
    assert some.exceptAll(docs.select(F.col("doc_id").alias("id"), "lang", "n_chars")).count() == 0
