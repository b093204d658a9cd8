"""Append-only logs: the tab-separated results log, experiment logs and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.functions import metrics


def append_results(rows: DataFrame, path: str) -> None:
    """Append rows to the results log. Each file carries the header, as readers of the folder expect."""
    (
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.RESULTS_LOG.fields])
        .write.mode("append").option("sep", "\t").option("header", True).csv(path)
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS_LOG).option("sep", "\t").option("header", True).csv(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """An experiment log; a number that does not parse becomes null and the status is tidied."""
    strings = spark.read.option("sep", "\t").option("header", True).csv(path)
    return strings.select(
        "commit",
        metrics.number(F.col("val_bpb")).alias("val_bpb"),
        metrics.number(F.col("memory_gb")).alias("memory_gb"),
        F.upper(F.trim("status")).alias("status"),
        "description",
    )


def validation_losses(lines: DataFrame, text: str = "value") -> DataFrame:
    """The ``(step, loss)`` of each validation line, with the other columns of the line."""
    kept = [c for c in lines.columns if c != text]
    found = lines.select(*kept, metrics.last_validation_loss(F.col(text)).alias("v")).filter(F.col("v").isNotNull())
    return found.select(*kept, F.col("v.step").alias("step"), F.col("v.loss").alias("loss"))


def last_validation_loss(lines: DataFrame, run: str, line_no: str, text: str = "value") -> DataFrame:
    """Per run, the step and loss of the last validation line."""
    losses = validation_losses(lines.select(run, line_no, text), text)
    return losses.groupBy(run).agg(F.max_by(F.struct("step", "loss"), line_no).alias("v")).select(run, "v.step", "v.loss")


def chunk_losses(chunks: DataFrame, run: str, completed: str, text: str = "log") -> DataFrame:
    """Step and loss per chunk of training: the step counts on from what was completed before."""
    return (
        chunks.select(run, completed, metrics.last_validation_loss(F.col(text)).alias("v")).filter(F.col("v").isNotNull())
        .select(run, (F.col(completed) + F.col("v.step")).alias("step"), F.col("v.loss").alias("loss"))
    )
