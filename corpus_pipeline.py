"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskaudit.llm import decontamination, jaccard, langid, packing, secrets
from maskaudit.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text looks like one of the languages, learned from the labels of these documents.

    NULL texts and those without a letter go, repeated rows are judged alike, and where no label teaches anything all go.
    """
    return langid.accepted(docs, langid.fit_on_documents(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: 80 % of the sets of five words in a row in common.

    It is the one with the smallest id. Rows that repeat an id and a text are one document, of which the smallest row stays;
    different texts under one id all stay, and so do rows without an id and texts without words, which are nobody's copy.
    """
    groups = jaccard.jaccard_components(docs, 5, (80, 100))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    rows = named.groupBy("doc_id", F.xxhash64("text").alias("_t")).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return rows.select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without a passage of the benchmark, edited ones included; NULL texts and items hold none."""
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, NULL texts and repeated rows too, with secrets replaced by their kind."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts, NULL ones as empty: a row per piece, with its ids and its place in a sequence."""
    return packing.pack(docs.select("doc_id", "text"), packing.vocabulary(), added=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: None: SQL cannot express the first stage, nor alignment and packing; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage but the last is written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
