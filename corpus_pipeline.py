"""The corpus pipeline: raw documents in, token ids of a mixed training corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared folder
and read again as the next stage's docs. All but the last return the columns of documents.

Null and empty texts pass all stages but mixing, which takes nothing of a document without words; repeated rows
are documents of their own in all stages but near-dedup, where rows of equal id count as one document. Empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, line_dedup, mixing, near_dup, toxicity
from foliospark.llm.common import read, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows outside the held-out fold."""
    model = toxicity.train(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    return toxicity.reject_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go, but for their first occurrence; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return near_dup.drop_near_duplicates(docs, percent=80, shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers) of each copy of a document."""
    ids = bpe.encode(F.col("text"), *bpe.vocabulary())
    return docs.select("doc_id", "source", ids.alias("ids")).select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("byte_bpe", encode)]

#: The classifier's scores and the byte-pair merges can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
