"""The registered queries of the training-data operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontam, fertility, hard_negatives, htmldiff, interleave, linededup, lm_ctw, minhash_icws, packing, quality_qda, spelling,
               toxicity, urlfilter)
from .common import crc_fold, table

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


def _held_out(k: int, rest: int):
    return F.coalesce(crc_fold("doc_id", k) == rest, F.lit(False)).alias("held_out")


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_fold("doc_id", 5) != 0)
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted", "evidence", "n_segments")


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_ctw.score(table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) != 2)
    return out.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_digest_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmldiff.extract(table(spark, sf_dir, "pages"))


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = minhash_icws.near_duplicates(table(spark, sf_dir, "documents"))
    return classes


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import materialize
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = materialize(quality_qda.with_statistics(docs), "qda_vectors")
    model = quality_qda.fit(vectors, docs, labels, "quality", crc_fold("doc_id", 3) != 1)
    return quality_qda.score(vectors, model).select("doc_id", _held_out(3, 1), "score", "predicted", "difference")


def op8_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "chars_per_token", "chars_per_token_bytes", "fallback_share", "entropy")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave.interleave(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, shifted)


QUERIES = {f.__name__: f for f in (op1_toxic_segments, op2_context_tree, op3_digest_url_filter, op4_line_runs, op5_page_differencing,
                                   op6_weighted_minhash, op7_quality_qda, op8_fertility_rules, op9_packing, op10_latent_decontamination,
                                   op11_interleaved_shards, op12_variable_grams, op13_secondary_sort_negatives)}
