"""Scores, run summaries, leaderboards and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from corpuslab.functions import metrics, scoring
from corpuslab.operators import evaluation
from corpuslab.session import checkpointed
from corpuslab.sources import logs

TARGETS = [
    {"name": "base", "backend": "local", "model": "m-base", "skill_path": None},
    {"name": "tuned", "backend": "local", "model": "m-tuned", "skill_path": None},
    {"name": "api+skill", "backend": "api", "model": "m-api", "skill_path": "skills/one"},
]

PAIRS = views.SUMMARY + """,
pairs_v AS (
  SELECT b.run_name AS baseline_run, c.run_name AS candidate_run,
    b.test_loss AS bl, c.test_loss AS cl, b.render_success_rate AS br, c.render_success_rate AS cr,
    b.syntax_success_rate AS bs, c.syntax_success_rate AS cs, b.mean_case_score AS bm, c.mean_case_score AS cm
  FROM summary_v b JOIN summary_v c ON CAST(substr(b.run_name, 5) AS INTEGER) % 7 + 1 = CAST(substr(c.run_name, 5) AS INTEGER))
"""


def pairs(spark, folder):
    """Each run against the next one, the last against the first. The summary, a row for each run, is rolled up once."""
    summary = checkpointed(views.summary(spark, folder))
    number = F.substring("run_name", 5, 9).cast("int")
    return evaluation.summary_pairs(
        summary.withColumn("pair_no", number % 7 + 1), summary.withColumn("pair_no", number), "pair_no",
        ("test_loss", "render_success_rate", "syntax_success_rate", "mean_case_score"),
    )


@query("snippet_checks", f"""WITH {views.CASES}
SELECT case_id,
  CASE WHEN len(must_contain) = 0 THEN 1.0::DOUBLE
    ELSE len(list_filter(must_contain, lambda s: contains(completion, s))) / CAST(len(must_contain) AS DOUBLE) END AS required_snippet_ratio,
  len(list_filter(must_not_contain, lambda s: contains(completion, s))) = 0 AS forbidden_ok FROM cases_v""")
def snippet_checks(spark, folder):
    rows = views.cases(spark, folder)
    return rows.select(
        "case_id",
        scoring.snippet_ratio(F.col("completion"), F.col("must_contain")).alias("required_snippet_ratio"),
        scoring.forbidden_ok(F.col("completion"), F.col("must_not_contain")).alias("forbidden_ok"),
    )


@query("case_score", f"WITH {views.RESULTS} SELECT run_name, case_id, round(weighted_score, 9) AS weighted_score FROM results_v")
def case_score(spark, folder):
    return views.results(spark, folder).select("run_name", "case_id", F.round("weighted_score", 9).alias("weighted_score"))


@query("case_status", f"""WITH {views.RESULTS}
SELECT run_name, CASE WHEN render_ok THEN 'Rendered' WHEN NOT syntax_ok THEN 'Syntax error'
  WHEN scene_name IS NULL THEN 'No scene detected' WHEN NOT render_ok THEN 'Render failed' ELSE 'Not attempted' END AS status,
  count(*) AS n_cases FROM results_v GROUP BY ALL""")
def case_status(spark, folder):
    return evaluation.case_status(views.results(spark, folder)).groupBy("run_name", "status").agg(F.count(F.lit(1)).alias("n_cases"))


@query("run_summary", f"""WITH {views.SUMMARY}
SELECT run_name, num_cases, syntax_success_rate, render_success_rate, mean_case_score FROM summary_v""")
def run_summary(spark, folder):
    return views.rounded(evaluation.run_summary(views.results(spark, folder)), views.RATES)


@query("leaderboard", f"""WITH {views.SUMMARY}
SELECT run_name, mean_case_score, render_success_rate, syntax_success_rate, row_number() OVER (
  ORDER BY mean_case_score DESC, coalesce(render_success_rate, 0) DESC, syntax_success_rate DESC, run_name) AS rank FROM summary_v""")
def leaderboard(spark, folder):
    return evaluation.leaderboard(views.summary(spark, folder)).select(
        "run_name", "mean_case_score", "render_success_rate", "syntax_success_rate", "rank"
    )


@query("case_count_consensus", f"""WITH {views.SUMMARY}
SELECT array_to_string(list_sort(list(DISTINCT num_cases)), ',') AS case_counts,
  CASE WHEN count(DISTINCT num_cases) = 1 THEN min(num_cases) ELSE -1 END AS num_cases FROM summary_v""")
def case_count_consensus(spark, folder):
    found = evaluation.case_count_consensus(views.summary(spark, folder))
    return found.select(F.array_join(F.transform("case_counts", lambda c: c.cast("string")), ",").alias("case_counts"), F.coalesce("num_cases", F.lit(-1)).alias("num_cases"))


@query("eval_grid", f"""WITH {views.HOLDOUT}
SELECT case_id, name, backend, model, skill_path FROM holdout_v, (VALUES ('base', 'local', 'm-base', NULL),
  ('tuned', 'local', 'm-tuned', NULL), ('api+skill', 'api', 'm-api', 'skills/one')) t(name, backend, model, skill_path)""")
def eval_grid(spark, folder):
    return evaluation.evaluation_grid(
        views.holdout(spark, folder), TARGETS, ("name", "backend", "model", "skill_path")
    ).drop("text")


@query("all_rendered_cases", f"""WITH {views.RESULTS},
listed AS (SELECT case_id, run_name, coalesce(render_ok, FALSE) AS ok, weighted_score FROM results_v WHERE run_name IN ('line3', 'line1', 'line2'))
SELECT case_id, count(*) = 3 AND bool_and(ok) AS complete,
  string_agg(run_name, ',' ORDER BY list_position(['line3', 'line1', 'line2'], run_name)) AS models FROM listed GROUP BY case_id""")
def all_rendered_cases(spark, folder):
    found = evaluation.all_rendered(views.results(spark, folder), ["line3", "line1", "line2"])
    return found.select("case_id", "complete", F.array_join(F.transform("rows", lambda r: r["name"]), ",").alias("models"))


@query("rendered_examples", f"""WITH {views.RESULTS},
wanted AS (SELECT 'o' || o_orderkey AS case_id, unnest(models) AS run_name, unnest(range(len(models))) AS place, o_orderstatus AS title FROM (
  SELECT *, CASE o_orderstatus WHEN 'F' THEN ['line2', 'line1'] WHEN 'O' THEN ['line1'] ELSE ['line3', 'line9'] END AS models FROM orders)),
met AS (SELECT w.*, r.case_id IS NOT NULL AS there, coalesce(r.render_ok, FALSE) AS ok FROM wanted w
  LEFT JOIN results_v r ON w.case_id = r.case_id AND w.run_name = r.run_name)
SELECT case_id, any_value(title) AS title, string_agg(run_name, ',' ORDER BY place) AS models,
  coalesce(string_agg(CASE WHEN ok THEN NULL WHEN there THEN run_name || ': not rendered' ELSE run_name || ': no result' END, ',' ORDER BY place), '') AS problems
FROM met GROUP BY case_id""")
def rendered_examples(spark, folder):
    """Every order asks for an example of its own models; many have no result, or none that rendered."""
    names = {"F": ("line2", "line1"), "O": ("line1",)}
    models = F.when(F.col("o_orderstatus") == "F", views.strings(*names["F"])).when(F.col("o_orderstatus") == "O", views.strings(*names["O"])).otherwise(views.strings("line3", "line9"))
    spec = views.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderstatus").alias("title"), F.lit("").alias("summary"), models.alias("models")
    )
    results = views.results(spark, folder).withColumn("prompt", F.lit(None).cast("string"))
    found = evaluation.rendered_examples(results, spec, strict=False)
    return found.select("case_id", "title", F.array_join(F.col("rows.name"), ",").alias("models"), F.array_join("problems", ",").alias("problems"))


@query("required_metrics", f"""WITH {views.SUMMARY}
SELECT run_name, 'not_reported' AS metric FROM summary_v UNION ALL SELECT run_name, 'render_success_rate' FROM summary_v WHERE render_success_rate IS NULL
UNION ALL SELECT run_name, 'test_loss' FROM summary_v WHERE NOT test_loss > 0.09""")
def required_metrics(spark, folder):
    """What each run does not report of the metrics that are asked for; a loss of at most 0.09 counts as not finite here."""
    summary = checkpointed(views.summary(spark, folder).withColumn("test_loss", F.when(F.col("test_loss") > 0.09, F.col("test_loss")).otherwise(float("nan"))))
    return evaluation.missing_metrics(evaluation.finite_metrics(summary), summary.select("run_name"), ["test_loss", "render_success_rate", "not_reported"])


@query("ab_deltas", f"""WITH {PAIRS}
SELECT baseline_run, candidate_run, round(cl - bl, 6) AS test_loss_delta, round(cr - br, 6) AS render_success_rate_delta,
  round(cm - bm, 6) AS mean_case_score_delta FROM pairs_v""")
def ab_deltas(spark, folder):
    deltas = ("test_loss_delta", "render_success_rate_delta", "mean_case_score_delta")
    return views.rounded(pairs(spark, folder), deltas).select("baseline_run", "candidate_run", *deltas)


@query("ab_decision", f"""WITH {PAIRS},
facts AS (SELECT *, bl - cl AS gain, coalesce(cr - br < -0.05, FALSE) AS bad FROM pairs_v),
staged AS (SELECT *, CASE WHEN gain >= 0.0001 AND NOT bad THEN 'candidate' WHEN bad THEN 'baseline'
  WHEN abs(gain) <= 0.00005 THEN CASE WHEN cm > bm THEN 'candidate' WHEN cm < bm THEN 'baseline' ELSE 'tie' END
  WHEN gain < 0 THEN 'baseline' ELSE 'tie' END AS stage FROM facts)
SELECT baseline_run, candidate_run, CASE WHEN stage <> 'tie' THEN stage WHEN bad THEN 'baseline'
  WHEN cm > bm THEN 'candidate' WHEN cm < bm THEN 'baseline' ELSE 'tie' END AS decision FROM staged""")
def ab_decision(spark, folder):
    limits = scoring.Acceptance(min_loss_delta=0.0001, tie_loss_delta=0.00005)
    return evaluation.ab_decisions(pairs(spark, folder), limits).select("baseline_run", "candidate_run", "decision")


def _winner(label, base, cand, lower):
    better = f"{cand} < {base}" if lower else f"{cand} > {base}"
    return f"""SELECT baseline_run, candidate_run, '{label}' AS metric,
  CASE WHEN {base} IS NULL OR {cand} IS NULL THEN 'n/a' WHEN abs({base} - {cand}) <= 1e-9 THEN 'Tie'
    WHEN {better} THEN 'Fine-tuned' ELSE 'Base' END AS winner FROM pairs_v"""


@query("metric_winner", "WITH " + PAIRS + " " + " UNION ALL ".join([
    _winner("Test Loss", "bl", "cl", True), _winner("Syntax Rate", "bs", "cs", False),
    _winner("Render Rate", "br", "cr", False), _winner("Case Score", "bm", "cm", False),
]))
def metric_winner(spark, folder):
    found = evaluation.metric_winners(pairs(spark, folder), ("baseline_run", "candidate_run"))
    return found.select("baseline_run", "candidate_run", "metric", "winner")


@query("metrics_long", f"""WITH {views.SUMMARY}
SELECT run_name, metric, value FROM (
  SELECT run_name, 'mean_case_score' AS metric, mean_case_score AS value FROM summary_v UNION ALL
  SELECT run_name, 'render_success_rate', render_success_rate FROM summary_v UNION ALL
  SELECT run_name, 'syntax_success_rate', syntax_success_rate FROM summary_v UNION ALL
  SELECT run_name, 'test_loss', CASE WHEN run_name <> 'line7' THEN test_loss END FROM summary_v UNION ALL
  SELECT run_name, 'num_cases', CAST(num_cases AS DOUBLE) FROM summary_v) WHERE value IS NOT NULL""")
def metrics_long(spark, folder):
    """One run's loss is not a number and has to fall out."""
    broken = views.summary(spark, folder).withColumn(
        "test_loss", F.when(F.col("run_name") == "line7", F.lit(float("nan"))).otherwise(F.col("test_loss"))
    )
    return evaluation.finite_metrics(broken)


@query("metric_format", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
  CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS whole,
  CASE WHEN l_discount = 0 THEN '0' ELSE CAST(CAST(round(l_discount, 6) AS DECIMAL(18, 6)) AS VARCHAR) END AS six,
  CASE WHEN l_discount = 0 THEN 'n/a' ELSE CAST(CAST(round(l_discount, 3) AS DECIMAL(18, 3)) AS VARCHAR) END AS three FROM lineitem""")
def metric_format(spark, folder):
    discount = F.col("l_discount")
    return views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        metrics.metric_text(F.col("l_quantity")).alias("whole"), metrics.metric_text(discount).alias("six"),
        metrics.report_text(F.when(discount != 0, discount)).alias("three"),
    )


@query("metric_assignments", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS name,
  CASE WHEN event_type IN ('click', 'view') THEN value END AS value,
  CASE event_type WHEN 'signup' THEN 'missing =' WHEN 'error' THEN 'blank name' WHEN 'purchase' THEN 'not a number' END AS problem FROM events""")
def metric_assignments(spark, folder):
    number = F.col("value").cast("string")
    assignment = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("signup "), number))
        .when(F.col("event_type") == "error", F.concat(F.lit(" ="), number))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("purchase=a="), number))
        .otherwise(F.concat(F.col("event_type"), F.lit(" = "), number))
    )
    return views.table(spark, folder, "events").select("event_id", metrics.parse_assignment(assignment).alias("p")).select("event_id", "p.*")


def _training_log(spark, folder):
    """Events as lines of training logs, one log per user."""
    line = F.when(
        F.col("event_type") == "purchase",
        F.format_string("Iter %d: Val loss %s, took 1s", F.col("event_id"), F.col("value").cast("decimal(18,2)").cast("string")),
    ).otherwise(F.format_string("Iter %d: Train loss %s", F.col("event_id"), F.col("value").cast("string")))
    return views.table(spark, folder, "events").select(F.col("user_id").alias("run_name"), "event_id", line.alias("value"))


@query("last_val_loss", """
SELECT user_id AS run_name, max(event_id) AS step, arg_max(value, event_id) AS loss FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def last_val_loss(spark, folder):
    return logs.last_validation_loss(_training_log(spark, folder), "run_name", "event_id")


@query("chunk_val_loss", """
SELECT user_id AS run_name, event_id + 100 AS step, value AS loss FROM events""")
def chunk_val_loss(spark, folder):
    """Several validation lines in one piece of log: the last one counts, from where the piece began."""
    chunk = F.format_string(
        "Iter 1: Val loss 9.5\nIter 50: Train loss 1.0\niter 100: val LOSS %s",
        F.col("value").cast("decimal(18,2)").cast("string"),
    )
    rows = views.table(spark, folder, "events").select(F.col("user_id").alias("run_name"), F.col("event_id").alias("done"), chunk.alias("log"))
    return logs.chunk_losses(rows, "run_name", "done")


@query("loss_metrics", """
SELECT event_id AS run_name, CASE WHEN event_type <> 'signup' THEN value END AS test_loss,
  CASE WHEN event_type = 'view' THEN value END AS test_perplexity FROM events""")
def loss_metrics(spark, folder):
    number = F.col("value").cast("decimal(18,2)").cast("string")
    log = (
        F.when(F.col("event_type") == "signup", F.lit("nothing to report"))
        .when(F.col("event_type") == "view", F.concat(F.lit("loss 77.5\nTest loss: "), number, F.lit("\nppl="), number))
        .when(F.col("event_type") == "click", F.concat(F.lit("train_loss 4\nloss= "), number))
        .otherwise(F.concat(F.lit("final LOSS "), number))
    )
    rows = views.table(spark, folder, "events").select(F.col("event_id").alias("run_name"), log.alias("log"))
    return evaluation.loss_metrics(rows)
