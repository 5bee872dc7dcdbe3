"""A corpus pipeline of five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.llm import op2, op3, op4, op5, op6
from loglens.llm.scratch import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts, texts without a letter and narrow margins go.

    Rows are judged by their text alone, so repeated rows and null ids are treated alike. What is judged is
    written here, since only table() bounds the batches in which texts pass to Python.
    """
    return table(op3.identify(docs, op3.learn(docs)).where("not rejected").select(*COLUMNS), "identified")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Documents with a null id stay; rows that share an id stay or go together.
    """
    gone = op4.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go.

    Null texts stay as they are, documents with a null id keep their words, and so do rows that share an id with
    the first that has a passage.
    """
    done = op5.remove_repeats(docs, carry=("lang", "source", "n_chars"), cleaned=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return done.where("n_removed = 0 or kept <> ''").select("doc_id", F.col("cleaned").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them.

    A null source is one source; null ids, repeated rows and documents without a word are documents like any
    others; of a source without any word nothing is taken.
    """
    return op2.mixed(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places; a document that the mix takes again has its pieces again."""
    return op6.packed_documents(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("mixing sources", mix),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage{i}")
    return docs
