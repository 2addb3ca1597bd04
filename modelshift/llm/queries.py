"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .common import new_folder, table
from .decontamination import find_contamination, hit_words
from .digest import fingerprint_documents
from .html import extract_text
from .lines import dedup_lines
from .packing import pack, tokenizer_text
from .pii import KINDS, find_personal_data
from .resampling import resample
from .simhash import near_duplicates
from .spelling import spelling_variants
from .sql import centroid_sql
from .suffixes import repeated_passages
from .tokens import read_tokens, token_digests, write_tokens
from .toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        F.col("id").alias("doc_id"), "held_out", "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_lines", F.size("dropped").alias("n_dropped"),
        F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words()
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def word_tokenizer() -> str:
    import public_tokenizers

    return tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), word_tokenizer())
    return packed.withColumnRenamed("id", "doc_id")


@query("op10_html")
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select(
        F.col("id").alias("page_id"), F.col("row.url").alias("url"), "text",
        F.length("text").cast("long").alias("n_chars"),
    )


@query("op5_digest")
def op5_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprint_documents(table(spark, sf_dir, "documents"))
    return prints.withColumnRenamed("id", "doc_id")


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def joined(spans):
        """kind:start:end by kind as listed, then start."""
        sortable = F.transform(spans, lambda s: F.struct(
            order[s["kind"]].alias("o"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.array_sort(sortable), lambda s: F.concat_ws(
            ":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), *map(count, KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )


@query("op9_resampling")
def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return sampled.withColumnRenamed("id", "doc_id")


@query("op7_passages")
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))

    def joined(spans):
        """start:end of word ranges, in order."""
        starts = F.filter(spans, lambda x, i: i % 2 == 0)
        ends = F.filter(spans, lambda x, i: i % 2 == 1)
        return F.array_join(F.zip_with(starts, ends, lambda a, b: F.concat_ws(
            ":", a.cast("string"), b.cast("string"))), ",")

    def words(spans):
        signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)

    return found.select(
        F.col("id").alias("doc_id"), "n_words", words("repeated").alias("n_repeated"),
        words("extra").alias("n_extra"), joined("repeated").alias("repeated_spans"),
        joined("extra").alias("extra_spans"), F.col("first").alias("first_doc_id"),
    )


@query("op13_centroids", centroid_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), word_tokenizer(), path)
    return token_digests(read_tokens(spark, path)).withColumnRenamed("id", "doc_id")


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
