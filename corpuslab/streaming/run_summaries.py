"""Live run summaries: the roll-up of a run, kept up to date as its case results arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpuslab.operators import evaluation
from corpuslab.streaming import snapshots

SUMMARY = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("num_cases", T.LongType()),
    T.StructField("syntax_success_rate", T.DoubleType()),
    T.StructField("render_success_rate", T.DoubleType()),
    T.StructField("mean_case_score", T.DoubleType()),
])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each run."""
    return snapshots.latest(spark, path, "run_name", SUMMARY)


def start(results: DataFrame, path: str, once: bool = False, every: int = snapshots.EVERY) -> StreamingQuery:
    """Aggregate scored results per run; the state is one row per run. ``every`` micro-batches the rows are folded into a base."""
    def publish(changed: DataFrame, number: int) -> None:
        snapshots.publish(changed.select(*SUMMARY.names), number, path, "run_name", every)

    writer = (
        evaluation.run_summary(results).writeStream.outputMode("update").foreachBatch(publish)
        .option("checkpointLocation", f"{path}/checkpoint")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
