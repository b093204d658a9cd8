"""Evaluation: score cases, roll runs up, rank runs and decide between two of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import metrics, scoring
from corpuslab.functions.text import first_truthy
from corpuslab.operators import keys, ordered

# Metrics of a run summary that reports look at (fixed values, fixed order).
SUMMARY_METRICS = (
    "mean_case_score", "render_success_rate", "syntax_success_rate", "test_loss", "test_perplexity", "num_cases",
)
# Metrics of the two-run comparison: (label, column, lower is better). Fixed values.
COMPARED_METRICS = (
    ("Test Loss", "test_loss", True),
    ("Syntax Rate", "syntax_success_rate", False),
    ("Render Rate", "render_success_rate", False),
    ("Case Score", "mean_case_score", False),
)


def evaluation_grid(cases: DataFrame, targets: Sequence[Mapping[str, str | None]], columns: Sequence[str]) -> DataFrame:
    """Every target with every case: the configured targets are an array literal, exploded per row,
    so no join is planned."""
    rows = F.array(*[F.struct(*[F.lit(t.get(c)).cast("string").alias(c) for c in columns]) for t in targets])
    return cases.withColumn("_target", F.explode(rows)).select("*", *[F.col(f"_target.{c}").alias(c) for c in columns]).drop("_target")


def score(df: DataFrame, weights: scoring.Weights = scoring.Weights(), code: str = "final_code") -> DataFrame:
    """Add the snippet checks and the weighted score to rows that hold code, checks to make and
    ``syntax_ok``, ``scene_name`` and ``render_ok``."""
    checked = df.withColumns({
        "required_snippet_ratio": scoring.snippet_ratio(F.col(code), F.col("must_contain")),
        "forbidden_ok": scoring.forbidden_ok(F.col(code), F.col("must_not_contain")),
    })
    return with_score(checked, weights)


def with_score(df: DataFrame, weights: scoring.Weights = scoring.Weights()) -> DataFrame:
    return df.withColumn("weighted_score", scoring.weighted_score(
        F.col("syntax_ok"), F.col("scene_name"), F.col("required_snippet_ratio"),
        F.col("forbidden_ok"), F.col("render_ok"), weights,
    ))


def run_summary(results: DataFrame, run: str = "run_name", extra: Sequence[Column] = ()) -> DataFrame:
    """One row per run. The render rate is over attempted renders only, and null when there is none.

    ``extra`` holds further aggregates to take in the same pass.
    """
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return results.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_cases"),
        F.avg(F.coalesce(F.col("syntax_ok"), F.lit(False)).cast("double")).alias("syntax_success_rate"),
        rate("render_ok").alias("render_success_rate"),
        F.avg("weighted_score").alias("mean_case_score"),
        *extra,
    )


def with_losses(summary: DataFrame, losses: DataFrame, run: str = "run_name") -> DataFrame:
    """Attach ``test_loss`` and ``test_perplexity`` where a run has them."""
    return summary.join(losses, run, "left")


def loss_metrics(logs: DataFrame, run: str = "run_name", text: str = "log") -> DataFrame:
    """Loss and perplexity of each run's log: the first pattern that matches, in order of preference."""
    return logs.select(
        run, metrics.test_loss(F.col(text)).alias("test_loss"), metrics.test_perplexity(F.col(text)).alias("test_perplexity")
    )


def leaderboard(summary: DataFrame, tie_break: str = "run_name", error: str | None = None) -> DataFrame:
    """Runs ranked by score, render rate and syntax rate, best first; ties by ``tie_break``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    completed = summary if error is None else summary.filter(F.col(error).isNull())
    best_first = [zero("mean_case_score").desc(), zero("render_success_rate").desc(), zero("syntax_success_rate").desc(), F.col(tie_break)]
    return ordered.ranked(completed, [], best_first)


def case_count_consensus(summary: DataFrame) -> DataFrame:
    """Distinct case counts of the completed runs, and the count itself when they agree."""
    distinct = summary.select("num_cases").where(F.col("num_cases").isNotNull()).distinct()
    return distinct.agg(F.sort_array(F.collect_list("num_cases")).alias("case_counts")).select(
        "case_counts", F.when(F.size("case_counts") == 1, F.get("case_counts", F.lit(0))).alias("num_cases")
    )


def summary_pairs(baseline: DataFrame, candidate: DataFrame, on: str, metric_columns: Sequence[str]) -> DataFrame:
    """Baseline and candidate summaries side by side with ``<metric>_delta`` = candidate - baseline."""
    left = baseline.select(on, F.col("run_name").alias("baseline_run"), *[F.col(m).alias(f"base_{m}") for m in metric_columns])
    right = candidate.select(on, F.col("run_name").alias("candidate_run"), *[F.col(m).alias(f"cand_{m}") for m in metric_columns])
    return left.join(right, on).withColumns({
        f"{m}_delta": F.col(f"cand_{m}") - F.col(f"base_{m}") for m in metric_columns
    })


def ab_decisions(pairs: DataFrame, limits: scoring.Acceptance = scoring.Acceptance()) -> DataFrame:
    """Add ``decision`` and ``rationale`` to paired summaries."""
    verdict = scoring.ab_decision(
        F.col("base_test_loss"), F.col("cand_test_loss"),
        F.col("base_render_success_rate"), F.col("cand_render_success_rate"),
        F.col("base_mean_case_score"), F.col("cand_mean_case_score"), limits,
    )
    return pairs.withColumn("_verdict", verdict).select(
        *pairs.columns, F.col("_verdict.decision").alias("decision"), F.col("_verdict.rationale").alias("rationale")
    )


def metric_winners(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per pair and compared metric: both values and who wins."""
    entries = F.array(*[
        F.struct(
            F.lit(label).alias("metric"), F.col(f"base_{c}").alias("base"), F.col(f"cand_{c}").alias("tuned"),
            F.lit(lower).alias("lower_is_better"),
        )
        for label, c, lower in COMPARED_METRICS
    ])
    return (
        pairs.select(*keep, F.explode(entries).alias("e"))
        .select(*keep, "e.metric", "e.base", "e.tuned", "e.lower_is_better")
        .withColumn("winner", scoring.metric_winner(F.col("base"), F.col("tuned"), F.col("lower_is_better")))
    )


def finite_metrics(summary: DataFrame, run: str = "run_name", names: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """Wide summary to ``(run, metric, value)``; null, NaN, infinite and boolean values are left out."""
    kinds = dict(summary.dtypes)
    numeric = [n for n in names if n in kinds and kinds[n] != "boolean"]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numeric])
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf")))
    return summary.select(run, F.explode(entries).alias("e")).select(run, "e.metric", "e.value").filter(finite)


def missing_metrics(long: DataFrame, runs: DataFrame, required: Sequence[str], run: str = "run_name") -> DataFrame:
    """``(run, metric)`` for each required metric a run does not report."""
    wanted = runs.select(run, F.explode(F.array(*[F.lit(n) for n in required])).alias("metric"))
    return wanted.join(long.select(run, "metric"), [run, "metric"], "left_anti")


def all_rendered(results: DataFrame, models: Sequence[str], case_ids: DataFrame | None = None) -> DataFrame:
    """Per case, one entry per listed model in list order; ``complete`` is false unless each rendered.

    The array holds one element per listed model, so its size is that of the list.
    """
    position = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("run_name"))
    listed = results.filter(F.col("run_name").isin(*models))
    if case_ids is not None:
        listed = listed.join(case_ids.select("case_id").distinct(), "case_id", "left_semi")
    one_each = listed.groupBy("case_id", "run_name").agg(
        F.every(F.coalesce("render_ok", F.lit(False))).alias("render_ok"),
        F.min("weighted_score").alias("weighted_score"),
        F.every(F.coalesce("syntax_ok", F.lit(False))).alias("syntax_ok"),
    )
    entry = F.struct(
        position.alias("position"), F.col("run_name").alias("name"), F.lit("Rendered").alias("status"),
        F.col("weighted_score").alias("score"), F.col("syntax_ok").alias("syntax_ok"),
    )
    return one_each.groupBy("case_id").agg(
        (F.every("render_ok") & (F.count(F.lit(1)) == len(models))).alias("complete"),
        F.sort_array(F.collect_list(entry)).alias("rows"),
    )


def rendered_examples(results: DataFrame, spec: DataFrame, strict: bool = True) -> DataFrame:
    """The listed examples, each with a row for every model that it lists, in list order.

    ``spec`` has ``case_id``, ``title``, ``summary`` and ``models``. A model that has no row for the case, or did not
    render it, makes the example incomplete and stands in ``problems``; with ``strict`` such an example is an error. An
    example without any row is still returned. The prompt is the first that is not empty, in list order.
    """
    listed = spec.select("case_id", "title", "summary", F.posexplode_outer("models").alias("position", "run_name"))
    one_each = results.groupBy("case_id", "run_name").agg(
        F.every(F.coalesce("render_ok", F.lit(False))).alias("render_ok"), F.every(F.coalesce("syntax_ok", F.lit(False))).alias("syntax_ok"),
        F.min("weighted_score").alias("score"), F.max("prompt").alias("prompt"),
    )
    joined = listed.join(one_each, ["case_id", "run_name"], "left")
    problem = F.when(F.col("run_name").isNull(), F.lit("no models")).when(F.col("render_ok").isNull(), F.concat("run_name", F.lit(": no result"))).when(
        ~F.col("render_ok"), F.concat("run_name", F.lit(": not rendered"))
    )
    entry = F.struct(
        "position", F.col("run_name").alias("name"), F.when(F.col("render_ok"), F.lit("Rendered")).alias("status"), "score", "render_ok", "syntax_ok",
        first_truthy(F.col("prompt")).alias("prompt"), problem.alias("problem"),
    )
    found = joined.groupBy("case_id").agg(F.any_value("title").alias("title"), F.any_value("summary").alias("summary"), F.sort_array(F.collect_list(entry)).alias("rows"))
    made = found.select(
        "case_id", "title", "summary", F.coalesce(F.get(F.array_compact(F.col("rows.prompt")), F.lit(0)), F.lit("")).alias("prompt"),
        F.transform("rows", lambda r: r.dropFields("prompt", "problem")).alias("rows"), F.array_compact(F.col("rows.problem")).alias("problems"),
    )
    if strict:
        keys.require_empty(made.filter(F.size("problems") > 0).select("case_id"), "Not valid all-rendered examples")
    return made


def case_status(results: DataFrame) -> DataFrame:
    return results.withColumn("status", scoring.case_status(F.col("render_ok"), F.col("syntax_ok"), F.col("scene_name")))
