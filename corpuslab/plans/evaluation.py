"""From model responses to scored cases, run summaries, a leaderboard and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import rewrite, scoring
from corpuslab.functions.text import extract_code
from corpuslab.operators import code, evaluation
from corpuslab.sources import payloads


def score_responses(responses: DataFrame, weights: scoring.Weights = scoring.Weights()) -> DataFrame:
    """Per-case results for rows with ``raw_response``, the snippets to check and, where the code was
    rendered, ``render_ok``.

    A render counts only for code that parses and defines a scene, as nothing else is rendered.
    """
    extracted = responses.withColumn("code", extract_code(F.col("raw_response")))
    rewritten = rewrite.normalise_code(extracted, "code", "final_code", "normalization_notes")
    profiled = code.profile(rewritten, "final_code")
    attempted = F.col("syntax_ok") & F.col("scene_name").isNotNull()
    return evaluation.score(profiled.withColumn("render_ok", F.when(attempted, F.col("render_ok"))), weights)


def repair_failed(scored: DataFrame, log: str = "render_log_tail") -> DataFrame:
    """Rows whose render failed, with the code the log's rules make of it; unchanged code is left out."""
    failed = scored.filter(F.col("render_ok") == F.lit(False))
    repaired = rewrite.repair_code(failed, "final_code", log)
    return repaired.filter(F.col("repaired_code") != F.col("final_code"))


def evaluate(responses: DataFrame, weights: scoring.Weights = scoring.Weights()) -> tuple[DataFrame, DataFrame]:
    """Scored cases and one summary per run."""
    scored = score_responses(responses, weights)
    return scored, evaluation.run_summary(scored)


def benchmark_report(entries: DataFrame, payload_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leaderboard, error rows and case-count consensus of the listed runs."""
    listed = payloads.report_entries(entries, payload_table)
    completed = listed.filter(F.col("error").isNull())
    return (
        evaluation.leaderboard(completed, tie_break="name"),
        listed.filter(F.col("error").isNotNull()).select("name", "category", "path", "error"),
        evaluation.case_count_consensus(completed),
    )
