"""Streams over the given tables, run until all that is there has been taken in."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import experiment_queries, views  # noqa: F401
from checks.registry import SQL, query
from corpuslab.operators import evaluation
from corpuslab.session import scratch_path
from corpuslab.streaming import early_stop, ratings, run_summaries


BATCHES = 4


def stream(spark, table, turn):
    """The rows of a table as a file stream of several micro-batches, one for each value of ``turn`` (0 to BATCHES - 1).

    The rows of a turn are dealt evenly to as many files as the table has partitions, which one micro-batch takes in.
    """
    path = scratch_path(spark, "arriving")
    numbered = table.withColumn("_turn", turn)
    files = max(1, numbered.rdd.getNumPartitions())
    for k in range(BATCHES):
        numbered.where(F.col("_turn") == k).drop("_turn").repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def quarters(key, most, jitter=0):
    """In which of BATCHES equal parts of 0 to ``most`` a key is, moved by a hash of at most ``jitter``."""
    moved = key + F.pmod(F.xxhash64(key), F.lit(jitter + 1))
    return F.least(F.floor(moved * BATCHES / (most + 1)), F.lit(BATCHES - 1)).cast("int")


@query("ratings_ingest", """
WITH r AS (SELECT 'doc-' || doc_id AS review_id, doc_id * 10 + k AS arrival,
  CASE WHEN k = 0 AND toxic = 1 THEN 'maybe' WHEN quality = 0 THEN 'reject' ELSE 'promote' END AS decision,
  doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'es') AS known FROM labels, (VALUES (0), (1), (2)) v(k)),
f AS (SELECT *, min(arrival) FILTER (known AND decision <> 'maybe') OVER (PARTITION BY review_id) AS first FROM r)
SELECT review_id, arrival, decision, CASE WHEN NOT known THEN 'unknown_item' WHEN arrival = first THEN 'accepted'
  WHEN arrival > first THEN 'already_rated' ELSE 'invalid_answer' END AS outcome FROM f""")
def ratings_ingest(spark, folder):
    """Each label gives three ratings of one item, the first of a toxic one no valid decision; they come in several micro-batches, the
    first ratings of all items before the others."""
    items = views.table(spark, folder, "documents").filter(F.col("lang") != "es").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("review_id")
    )
    given = views.table(spark, folder, "labels").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("review_id"),
        (F.col("doc_id") * 10 + F.col("k")).alias("arrival"),
        F.when((F.col("k") == 0) & (F.col("toxic") == 1), "maybe").when(F.col("quality") == 0, "reject").otherwise("promote").alias("decision"),
    )
    arriving = stream(spark, given, F.pmod("arrival", F.lit(10)).cast("int"))
    path = scratch_path(spark, "ratings")
    ratings.start(arriving, items, path, "arrival", "sample_review", once=True).awaitTermination()
    columns = ["review_id", "arrival", "decision"]
    accepted = spark.read.parquet(f"{path}/accepted").select(*columns, F.lit("accepted").alias("outcome"))
    refused = spark.read.parquet(f"{path}/refused").select(*columns, F.col("reason").alias("outcome"))
    return accepted.unionByName(refused)


@query("live_run_summary", f"""WITH {views.RAW_RESULTS}, scored AS (SELECT *, {views.SCORE} AS weighted_score FROM raw_results_v)
SELECT run_name, count(*) AS num_cases, round(avg(CAST(syntax_ok AS DOUBLE)), 6) AS syntax_success_rate,
  round(avg(CAST(render_ok AS DOUBLE)), 6) AS render_success_rate, round(avg(weighted_score), 6) AS mean_case_score FROM scored GROUP BY run_name""")
def live_run_summary(spark, folder):
    lines = views.table(spark, folder, "lineitem")
    arriving = evaluation.with_score(views.as_results(stream(spark, lines, F.pmod("l_orderkey", F.lit(BATCHES)).cast("int"))))
    path = scratch_path(spark, "run-summaries")
    run_summaries.start(arriving, path, once=True, every=3).awaitTermination()
    return views.rounded(run_summaries.latest(spark, path), views.RATES)


@query("live_early_stop", f"""SELECT CAST(run_name AS VARCHAR) AS run_name, best_step, best_loss, stop_step, stopped FROM (
{SQL['early_stop']})""")
def live_early_stop(spark, folder):
    """Steps come in several micro-batches and out of order across them."""
    given = views.table(spark, folder, "events").select(F.col("user_id").alias("run_name"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    most = given.agg(F.coalesce(F.max("step"), F.lit(0))).first()[0]
    jitter = max(1, most // 20)
    path = scratch_path(spark, "early-stop")
    early_stop.start(stream(spark, given, quarters(F.col("step"), most, jitter)), path, once=True, every=3, slack=jitter).awaitTermination()
    return early_stop.latest(spark, path).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))
