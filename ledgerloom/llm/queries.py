"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, shared_dir
from ledgerloom.llm.exact import exact_dedup
from ledgerloom.llm import merkle, quality
from ledgerloom.llm.language import fit_languages, in_fold, predict_languages
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.packing import pack_on_curve
from ledgerloom.llm.repeats import remove_repeats
from ledgerloom.llm.simhash import simhash_groups
from ledgerloom.llm.token_counts import token_counts
from ledgerloom.llm.token_files import read_token_files, write_token_files
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity
from ledgerloom.llm.weak_labels import weak_quality
from ledgerloom.llm.whitening import whiten


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.quality_rules(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.filter(~in_fold("doc_id", 4, 2)))
    return predict_languages(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~in_fold("doc_id", 3, 1))
    return score_toxicity(docs, fit_toxicity(labels, docs)).select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_on_curve(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_proofs(documents(spark, sf_dir), merkle.changed_text()).drop("proof")


QUERIES = {
    f.__name__: f
    for f in (op1_token_files, op2_quality_rules, op3_simhash, op4_weak_quality, op5_exact_dedup, op6_language, op7_toxicity, op8_substring_dedup, op9_mixing, op10_packing, op11_token_counts, op12_whitening, op13_merkle)
}

ORACLES = {
    "op13_merkle": merkle.ORACLE,
    "op2_quality_rules": quality.oracle(),
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents),
g AS (SELECT bare, count(*) AS n, arg_min(doc_id, (-length(text), doc_id)) AS keep_id FROM t GROUP BY bare)
SELECT t.doc_id, g.keep_id, g.n::BIGINT AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.bare) AS text_sha256
FROM t JOIN g ON t.bare = g.bare
""",
}
