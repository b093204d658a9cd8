"""Experiment logs and loss series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from corpuslab.operators import experiments


def log(spark, folder):
    return experiments.clean_log(views.experiments(spark, folder))


def evals(spark, folder):
    return views.table(spark, folder, "events").select(
        F.col("user_id").alias("run_name"), F.col("event_id").alias("step"), F.col("value").alias("loss"),
        ((F.get_json_object("props", "$.k").cast("double") + 1) / 100).alias("seconds"),
    )


KEPT = views.EXPERIMENTS + ", kept_v AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY idx) AS kept_no, lag(metric) OVER (PARTITION BY campaign ORDER BY idx) AS previous_metric FROM explog_v WHERE status = 'KEEP')"


@query("outcome_counts", f"""WITH {views.EXPERIMENTS}
SELECT campaign, count(*) AS n_total, count(*) FILTER (status = 'KEEP') AS n_keep, count(*) FILTER (status = 'DISCARD') AS n_discard,
  count(*) FILTER (status = 'CRASH') AS n_crash,
  CASE WHEN count(*) FILTER (status IN ('KEEP', 'DISCARD')) > 0
    THEN count(*) FILTER (status = 'KEEP') / CAST(count(*) FILTER (status IN ('KEEP', 'DISCARD')) AS DOUBLE) END AS keep_rate
FROM explog_v GROUP BY campaign""")
def outcome_counts(spark, folder):
    return experiments.outcome_counts(log(spark, folder))


@query("running_best", f"""WITH {views.EXPERIMENTS}
SELECT campaign, idx, metric, min(metric) OVER (PARTITION BY campaign ORDER BY idx) AS best_so_far FROM explog_v WHERE status = 'KEEP' AND metric IS NOT NULL""")
def running_best(spark, folder):
    return experiments.running_best(log(spark, folder)).select("campaign", "idx", "metric", "best_so_far")


@query("kept_deltas", f"WITH {KEPT} SELECT campaign, idx, kept_no, previous_metric - metric AS delta FROM kept_v WHERE kept_no > 1")
def kept_deltas(spark, folder):
    return experiments.kept_deltas(log(spark, folder)).select("campaign", "idx", "kept_no", "delta")


@query("top_hits", f"""WITH {KEPT}
SELECT campaign, idx, description, previous_metric - metric AS delta,
  row_number() OVER (PARTITION BY campaign ORDER BY previous_metric - metric DESC NULLS LAST, idx) AS hit_rank FROM kept_v WHERE kept_no > 1""")
def top_hits(spark, folder):
    return experiments.top_hits(log(spark, folder)).select("campaign", "idx", "description", "delta", "hit_rank")


@query("total_improvement", f"""WITH {KEPT}
SELECT campaign, round(sum(previous_metric - metric), 6) AS total_delta, count(*) AS n_hits FROM kept_v WHERE kept_no > 1 GROUP BY campaign""")
def total_improvement(spark, folder):
    return views.rounded(experiments.total_improvement(log(spark, folder)), ["total_delta"])


@query("improvement_summary", f"""WITH {views.EXPERIMENTS},
s AS (SELECT campaign, arg_min(metric, idx) AS baseline, min(metric) FILTER (status = 'KEEP') AS best,
  first(description ORDER BY metric, idx) FILTER (status = 'KEEP') AS best_description FROM explog_v GROUP BY campaign)
SELECT campaign, baseline, best, best_description, baseline - best AS gain, round(100 * (baseline - best) / baseline, 6) AS gain_pct FROM s""")
def improvement_summary(spark, folder):
    return views.rounded(experiments.improvement_summary(log(spark, folder)), ["gain_pct"])


@query("near_baseline", f"""WITH {views.EXPERIMENTS},
v AS (SELECT *, first_value(metric) OVER (PARTITION BY campaign ORDER BY idx) AS baseline FROM explog_v WHERE status <> 'CRASH')
SELECT campaign, idx, status, metric, baseline FROM v WHERE metric <= baseline + 0.0005""")
def near_baseline(spark, folder):
    return experiments.near_baseline(log(spark, folder)).select("campaign", "idx", "status", "metric", "baseline")


@query("early_stop", """WITH RECURSIVE
e AS (SELECT user_id AS run_name, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (
  SELECT run_name, n, step AS best_step, loss AS best_loss, 0 AS stale, CAST(NULL AS BIGINT) AS stop_step FROM e WHERE n = 1
  UNION ALL
  SELECT e.run_name, e.n,
    CASE WHEN e.loss < w.best_loss - 0.01 THEN e.step ELSE w.best_step END,
    CASE WHEN e.loss < w.best_loss - 0.01 THEN e.loss ELSE w.best_loss END,
    CASE WHEN e.loss < w.best_loss - 0.01 THEN 0 ELSE w.stale + 1 END,
    CASE WHEN e.loss >= w.best_loss - 0.01 AND w.stale + 1 >= 3 THEN e.step END
  FROM w JOIN e ON e.run_name = w.run_name AND e.n = w.n + 1 WHERE w.stop_step IS NULL)
SELECT w.run_name, arg_max(best_step, w.n) AS best_step, arg_max(best_loss, w.n) AS best_loss, coalesce(max(stop_step), -1) AS stop_step,
  max(stop_step) IS NOT NULL AS stopped, (SELECT count(*) FROM events v WHERE v.user_id = w.run_name) AS n_evals
FROM w GROUP BY w.run_name""")
def early_stop(spark, folder):
    return experiments.early_stop(evals(spark, folder)).withColumn("stop_step", F.coalesce("stop_step", F.lit(-1)))


BETAS = (0.4, 0.9, 0.99)


@query("ema_loss", """
WITH e AS (SELECT user_id AS run_name, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
b AS (SELECT unnest([0.4, 0.9, 0.99]::DOUBLE[]) AS beta)
SELECT beta, a.run_name, a.step, a.n AS step_no, round(sum((1 - beta) * pow(beta, a.n - h.n) * h.loss) / (1 - pow(beta, a.n + 1)), 6) AS smooth_loss
FROM b, e a JOIN e h ON a.run_name = h.run_name AND h.n <= a.n GROUP BY beta, a.run_name, a.step, a.n""")
def ema_loss(spark, folder):
    steps = evals(spark, folder).select("run_name", "step", "loss")
    rows = experiments.smoothed_losses(steps, BETAS).select("beta", "run_name", "step", "step_no", "smooth_loss")
    return views.rounded(rows, ["smooth_loss"])


@query("training_telemetry", """
WITH e AS (SELECT user_id AS run_name, value AS loss, (CAST(json_extract(props, '$.k') AS DOUBLE) + 1) / 100 AS seconds,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
SELECT run_name, count(*) AS n_steps, count(*) FILTER (loss > 100) AS n_failed, round(coalesce(sum(seconds) FILTER (n > 10), 0), 6) AS training_seconds,
  CAST(min(floor(524288 / seconds)) AS BIGINT) AS slowest, round(max(100 * 6e9 * 524288 / seconds / 989.5e12), 6) AS best_mfu
FROM e GROUP BY run_name""")
def training_telemetry(spark, folder):
    numbered = experiments.smoothed_loss(evals(spark, folder))
    steps = experiments.step_telemetry(numbered, "seconds", 524288, 6e9)
    extremes = [F.min("tok_per_sec").alias("slowest"), F.round(F.max("mfu_pct"), 6).alias("best_mfu")]
    return views.rounded(experiments.training_time(steps, "run_name", "seconds", extremes), ["training_seconds"])
