"""Ratings ingest: the first valid rating of an item counts, everything else goes to a dead-letter table.

``route`` judges one batch against the ids accepted before it. The stream holds these ids in keyed state instead, so a
micro-batch costs what it brings, however many ratings have come before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpuslab.operators.review import PAIR_VERDICTS, SAMPLE_DECISIONS
from corpuslab.session import checkpointed
from corpuslab.streaming import state

# Rows whose id decides nothing are spread over so many keys.
SPREAD = 256
MISSING_ID, REPEATED, UNKNOWN, INVALID = "missing_id", "already_rated", "unknown_item", "invalid_answer"


def answers(session_type: str) -> tuple[str, tuple[str, ...]]:
    """The answer column of a session type and the values it may take."""
    return ("decision", SAMPLE_DECISIONS) if session_type == "sample_review" else ("verdict", PAIR_VERDICTS)


def route(
    ratings: DataFrame, items: DataFrame, earlier: DataFrame, arrival: str, session_type: str = "blind_pair"
) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused rows of one batch, given the ids accepted before it.

    ``arrival`` orders the rows of a batch; without it the winner of a tie would depend on task order.
    What decides is gathered per id first (whether it is known, was rated before, and when its first
    valid answer came), after a map-side minimum. The rows meet those facts in a single join, so an id
    with a large share of the ratings is a skewed side that the adaptive planner can split.
    """
    column, allowed = answers(session_type)
    valid = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    known = items.select("review_id").distinct().withColumn("_known", F.lit(True))
    before = earlier.select("review_id").distinct().withColumn("_before", F.lit(True))
    # Equal arrivals are told apart by their rows' contents; rows that are equal throughout, by a number. The rows
    # are checkpointed, so that both uses see the same numbers.
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in ratings.columns])))
    numbered = checkpointed(ratings.withColumn("_turn", F.struct(F.col(arrival), content, F.monotonically_increasing_id())))
    facts = (
        numbered.groupBy("review_id").agg(F.min(F.when(valid, F.col("_turn"))).alias("_first"))
        .join(known, "review_id", "left").join(before, "review_id", "left")
    )
    reason = (
        F.when(F.col("review_id").isNull(), MISSING_ID)
        .when(F.col("_before"), REPEATED)
        .when(F.col("_known").isNull(), UNKNOWN)
        .when(F.col("_turn") > F.col("_first"), REPEATED)
        .when(~valid, INVALID)
    )
    routed = numbered.join(facts, "review_id", "left").withColumn("reason", reason)
    return (
        routed.filter(F.col("reason").isNull()).select(*ratings.columns),
        routed.filter(F.col("reason").isNotNull()).select(*ratings.columns, "reason"),
    )


def _write(df: DataFrame, path: str, batch: int) -> None:
    """Replace this batch's partition only: a batch that is run again after a failure writes the same rows."""
    (
        df.withColumn("batch_id", F.lit(batch).cast("long")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def read_ratings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


class FirstValid(StatefulProcessor):
    """Per id: whether an answer was accepted. The first valid row by arrival, then content, is; all others are refused."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "turn string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows, first = sorted(rows, key=lambda r: (r["_arrival"] is not None, r["_arrival"], r["_content"])), None
        known = key[0] is not None and rows[0]["_known"]
        before = known and self.accepted.exists()
        if known and not before:
            first = next((k for k, r in enumerate(rows) if r["_valid"]), None)
            if first is not None:
                self.accepted.update((str(rows[first]["_arrival"]),))
        for k, row in enumerate(rows):
            if key[0] is None:
                reason = MISSING_ID
            elif before:
                reason = REPEATED
            elif not known:
                reason = UNKNOWN
            elif first is not None and k > first:
                reason = REPEATED
            else:
                reason = None if k == first else INVALID
            yield Row(**{c: row[c] for c in self.columns}, reason=reason)

    def close(self) -> None:
        pass


def routed(stream: DataFrame, items: DataFrame, arrival: str, session_type: str = "blind_pair") -> DataFrame:
    """``stream`` with ``reason``: null for the first valid rating of each known item, else why a row is refused.

    The state holds one short value for each accepted id. Rows of one id that a micro-batch brings are judged together in
    one task (``maxFilesPerTrigger`` bounds them); rows without an id, or of unknown items, are spread over many keys.
    """
    column, allowed = answers(session_type)
    known = items.select("review_id").distinct().withColumn("_known", F.lit(True))
    content = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns])))
    facts = stream.join(known, "review_id", "left").withColumns({
        "_known": F.coalesce("_known", F.lit(False)), "_valid": F.coalesce(F.col(column).isin(*allowed), F.lit(False)),
        "_arrival": F.col(arrival), "_content": content,
    })
    alone = F.col("review_id").isNull() | ~F.col("_known")
    keyed = facts.withColumn("_salt", F.when(alone, F.pmod("_content", F.lit(SPREAD))).otherwise(F.lit(-1)))
    schema = T.StructType([*stream.schema.fields, T.StructField("reason", T.StringType())])
    return keyed.groupBy("review_id", "_salt").transformWithState(FirstValid(stream.columns), schema, "Append", "None")


def start(
    stream: DataFrame, items: DataFrame, path: str, arrival: str, session_type: str = "blind_pair", once: bool = False
) -> StreamingQuery:
    """Start the ingest: ``<path>/accepted``, ``<path>/refused`` and its checkpoint, with the state, below ``path``."""
    spark, columns = stream.sparkSession, stream.columns
    accepted_path, refused_path = f"{path}/accepted", f"{path}/refused"
    empty = spark.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())]))
    empty.write.mode("append").partitionBy("batch_id").parquet(accepted_path)

    def ingest(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            _write(batch.where(F.col("reason").isNotNull()), refused_path, number)
            _write(batch.where(F.col("reason").isNull()).select(*columns), accepted_path, number)
        finally:
            batch.unpersist()

    with state.keyed_store(spark):
        writer = routed(stream, items, arrival, session_type).writeStream.foreachBatch(ingest).option("checkpointLocation", f"{path}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()
