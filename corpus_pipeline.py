"""A corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenlake.llm import bpe, decontam, minhash, substring, toxicity
from eigenlake.llm.queries import tokenizer
from eigenlake.llm.state import shared_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of ``sf_dir``, doesn't reject; each row is judged by its own text, and one without words stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, toxicity.grades_of(labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near-duplicates; rows that share an id are one document and go or stay together, rows without an id stay."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that a document of a smaller id has; n_chars follows the text, rows without an id stay as they are."""
    return substring.strip_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; rows that share an id go together, those without an id each by its text."""
    keyed = docs.withColumn("_key", F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("text")))
    found = decontam.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select(F.col("_key").alias("_leaking")).distinct()
    return keyed.join(found, F.col("_key").eqNullSafe(F.col("_leaking")), "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the text they decode to."""
    return bpe.digest_documents(docs, *tokenizer())


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", strip_repeats), ("decontamination", drop_leaks), ("bpe", encode)]

#: SQL can't express the trained model of the first stage.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written to the shared folder and read again.

    A stage's files are removed once the next one's are written; those of the
    last but one stay, as the result is computed from them.
    """
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
