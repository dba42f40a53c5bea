"""A corpus from raw documents to packed windows, in five stages.

Each stage takes all that the stage before it kept, written as Parquet in the shared folder and read again, so a lost executor
costs no more than tasks of one stage; what a stage wrote goes when the next one has written. All but the last return the columns
of ``documents``, of any names.

Null or empty texts: quality drops them. Repeated rows: each is judged for itself until near_duplicates, which keeps one row of an
id and one id of a class; rows with a null id pass it. Ties: the least id, the least text. An empty table passes all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogsmith.llm import language_id, near_duplicates, pii, quality_classifier
from catalogsmith.llm.packing import Packer
from catalogsmith.llm.queries import TOKENIZERS
from catalogsmith.llm.sparkio import quoted, removed, table, written

#: A document stays if the language named for it has at least this mean probability over its words.
LEAST_LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the hierarchical classifier rejects."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.kept(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of no clear language."""
    model = language_id.train(docs)
    found = language_id.identify(docs, model, keep=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near-duplicates the document of least id; rows without an id stay. Of rows with one id the one of
    least text stays (a null text before all)."""
    found = near_duplicates.classes(docs.where("doc_id is not null"))
    own = F.count_if(F.col("doc_id") == F.col("class_id")).alias("rows")
    # the ids to drop, and those of several rows: fewer than the ids that stay, so texts are seldom shuffled to meet them
    others = written(found.groupBy("doc_id").agg(own).where("rows != 1"), "pipeline-others")
    kept = docs.where("doc_id is not null").join(others.select("doc_id"), "doc_id", "left_anti")
    out = kept.select(*map(quoted, docs.columns)).unionByName(docs.where("doc_id is null"))
    if (twice := others.where("rows > 1").select("doc_id")).isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    repeated = docs.join(twice, "doc_id", "left_semi").select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), place.alias("place"))
    return out.unionByName(repeated.where("place = 1").select("row.*"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what reveals it; n_chars follows the text."""
    clean = pii.sanitise(docs)
    others = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return clean.select(*(others.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows."""
    return Packer(spark, f"{TOKENIZERS}/word_bpe_49k.json").pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", deduplicate), ("pii", sanitise), ("packing", pack)]

#: SQL can't express the models of the first stages; the tests hold what each stage keeps against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
