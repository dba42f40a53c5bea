"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, filter_audit, language_id, near_duplicates, pii, quality_classifier, token_index, toxicity, vector_codes
from .byte_bpe import Tokenizer
from .packing import Packer
from .quality_rules import judge
from .sparkio import deleted, shared_dir, table, written

#: The folder of the public tokenizers' files, and the pattern that splits text before the merges of the rank files.
TOKENIZERS = os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
PATTERN = public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packer(spark, public_tokenizers.path("word_bpe_49k.json")).pack(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"), with_text=False)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), PATTERN).digests(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).select("doc_id", "p_doc", "p_site", "quality_score", "quality_kept")


def _remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=_remainder(3) != 1)
    return toxicity.score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_remainder(4) != 2))
    return language_id.identify(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "n_switches")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_windows(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op11_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, folder = token_index.digests(table(spark, sf_dir, "documents"), shared_dir(spark), public_tokenizers.path("word_bpe_49k.json"))
    out = written(found, "op11")
    deleted(spark, folder)
    return out


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = vector_codes.with_label_errors(written(vector_codes.encode(vectors, books), "op12"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_packing, op3_near_duplicates, op4_pii, op5_nearest_neighbours, op6_byte_bpe, op7_quality_classifier, op8_toxicity, op9_language_id, op10_chat, op11_token_index, op12_vector_codes, op13_filter_audit)
}
ORACLES: dict[str, str] = {"op10_chat": chat.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
