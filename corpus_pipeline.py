"""From raw documents to a weighted training set: five stages, each one operator over all rows that the one before kept.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; ``run`` writes every stage's
rows as Parquet to the shared folder and hands the reread table to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import common, decontamination, exact_dedup, language_id, mixing, near_dedup
from corpuslab.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a letter go: no language can be told."""
    model = language_id.learn(docs.where(~common.held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).where(F.col("_lang_pred") != language_id.UNDETERMINED).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, common.table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their rate and number of copies; those with rate 0 are outside the mix and go."""
    rows, _ = mixing.mixed(docs, common.table(spark, folder, "labels"))
    return rows.where(F.col("rate") > 0)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
# Three stages learn models, so SQL cannot give the rows of run(); tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
