"""Evaluation payloads: one JSON document per run, with a summary and its cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import schemas

MISSING = "artifact missing"
NO_SUMMARY = "no summary payload"


def plain_path(path: Column, base: str | None = None) -> Column:
    """One form for ``file:/x``, ``file:///x`` and ``/x``; a relative path is taken from ``base``."""
    bare = F.regexp_replace(path, "^file:(//)?(?=/)", "")
    if base is None:
        return bare
    return F.when(bare.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), bare).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), bare))


def read_payloads(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All payloads below the paths, each with its ``path``."""
    return (
        spark.read.schema(schemas.EVAL_PAYLOAD).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(path if isinstance(path, str) else list(path))
        .withColumn("path", plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))
    )


def report_entries(entries: DataFrame, payloads: DataFrame, base: str | None = None) -> DataFrame:
    """Listed runs with their summary, or with the ``error`` that keeps them out of the ranking.

    ``entries`` holds name, category and path (relative to ``base``, if given); a path without a payload is an
    error row, not a failure.
    """
    found = payloads.select(plain_path(F.col("path"), base).alias("_path"), F.lit(True).alias("_found"), "summary", F.col("error").alias("_error"))
    joined = entries.join(found, plain_path(F.col("path"), base) == F.col("_path"), "left")
    error = F.when(F.col("_found").isNull(), MISSING).when(
        F.col("summary").isNull(), F.coalesce("_error", F.lit(NO_SUMMARY))
    )
    return joined.select("name", "category", "path", "summary.*", error.alias("error"))


def case_results(payloads: DataFrame) -> DataFrame:
    """One row per run and case."""
    return payloads.select(
        "run_name", "base_model", "adapter_path", "dataset_dir", F.explode("cases").alias("c")
    ).select("run_name", "base_model", "adapter_path", "dataset_dir", "c.*")


def write_payloads(summary: DataFrame, results: DataFrame, path: str, run: str = "run_name") -> None:
    """Summaries and case rows as two tables below ``path``, partitioned by run.

    A payload is not assembled into one document: that would bring all cases of a run to one task. Rows are rebalanced
    by run first, so a run has a file for each so many of its bytes instead of one for each task that holds some of it.
    """
    summary.hint("rebalance", run).write.mode("overwrite").partitionBy(run).json(f"{path}/summary")
    results.hint("rebalance", run).write.mode("overwrite").partitionBy(run).json(f"{path}/cases")


def results_log_rows(summary: DataFrame) -> DataFrame:
    """Rows for the results log; columns the summary lacks are null."""
    return summary.select(*[
        (F.col(f.name) if f.name in summary.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.RESULTS_LOG.fields
    ])
