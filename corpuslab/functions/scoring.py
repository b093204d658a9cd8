"""Per-case scores, status labels and run-against-run decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    """Share of each check in a case's score (fixed defaults)."""

    syntax: float = 0.25
    scene_class: float = 0.15
    required_snippets: float = 0.25
    forbidden_snippets: float = 0.05
    render: float = 0.30


@dataclass(frozen=True)
class Acceptance:
    """Thresholds of the baseline-against-candidate decision (fixed defaults)."""

    min_loss_delta: float = 0.01
    tie_loss_delta: float = 0.003
    allowed_render_regression: float = 0.05


def snippet_ratio(code: Column, required: Column) -> Column:
    """Share of the required snippets found in the code; 1.0 when none is required."""
    found = F.size(F.filter(required, lambda s: F.contains(code, s)))
    return F.when(F.coalesce(F.size(required), F.lit(0)) <= 0, F.lit(1.0)).otherwise(
        found.cast("double") / F.size(required).cast("double")
    )


def forbidden_ok(code: Column, forbidden: Column) -> Column:
    """No forbidden snippet occurs; an empty snippet occurs everywhere, so it fails the case."""
    return F.coalesce(F.forall(forbidden, lambda s: ~F.contains(code, s)), F.lit(True))


def _truth(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def weighted_score(
    syntax_ok: Column, scene_name: Column, ratio: Column, forbidden: Column, render_ok: Column, weights: Weights = Weights()
) -> Column:
    """Weighted mean of the checks; the render check counts only where it was made."""
    static_total = weights.syntax + weights.scene_class + weights.required_snippets + weights.forbidden_snippets
    full_total = static_total + weights.render
    static_points = (
        F.lit(weights.syntax) * _truth(syntax_ok)
        + F.lit(weights.scene_class) * _truth(F.coalesce(scene_name, F.lit("")) != "")
        + F.lit(weights.required_snippets) * ratio
        + F.lit(weights.forbidden_snippets) * _truth(forbidden)
    )
    return F.when(render_ok.isNull(), static_points / F.lit(static_total or 1.0)).otherwise(
        (static_points + F.lit(weights.render) * _truth(render_ok)) / F.lit(full_total or 1.0)
    )


def case_status(render_ok: Column, syntax_ok: Column, scene_name: Column) -> Column:
    """One label per case; an unknown syntax result counts as good."""
    return (
        F.when(F.coalesce(render_ok, F.lit(False)), "Rendered")
        .when(~F.coalesce(syntax_ok, F.lit(True)), "Syntax error")
        .when(F.coalesce(scene_name, F.lit("")) == "", "No scene detected")
        .when(render_ok == F.lit(False), "Render failed")
        .otherwise("Not attempted")
    )


def metric_winner(base: Column, tuned: Column, lower_is_better: Column) -> Column:
    """``n/a``, ``Tie`` (within a part in a thousand million) or the better side."""
    missing = base.isNull() | tuned.isNull() | F.isnan(base) | F.isnan(tuned)
    gap = F.abs(base - tuned)
    close = (base == tuned) | (
        (gap <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(base), F.abs(tuned)), F.lit(1e-9))) & (gap < F.lit(float("inf")))
    )
    tuned_wins = F.when(lower_is_better, tuned < base).otherwise(tuned > base)
    return F.when(missing, "n/a").when(close, "Tie").when(tuned_wins, "Fine-tuned").otherwise("Base")


# Rationale lines of the decision (fixed wording).
RENDER_REGRESSED = "candidate regressed on render_success_rate beyond the allowed threshold"
LOSS_IMPROVED = "candidate improves held-out loss without unacceptable render regression"
LOSS_REGRESSED = "candidate regressed on held-out loss"
TIED_CANDIDATE = "loss is effectively tied and candidate wins on generation quality"
TIED_BASELINE = "loss is effectively tied and baseline wins on generation quality"
SCORE_CANDIDATE = "candidate wins on mean case score"
SCORE_BASELINE = "baseline wins on mean case score"


def ab_decision(
    base_loss: Column, cand_loss: Column, base_render: Column, cand_render: Column,
    base_score: Column, cand_score: Column, limits: Acceptance = Acceptance(),
) -> Column:
    """``struct(decision, rationale)`` for a candidate run against a baseline run.

    The loss stage decides first where both losses are known; what it leaves tied goes to the
    score stage. A missing score leaves the pair tied.
    """
    loss_gain = base_loss - cand_loss
    losses_known = loss_gain.isNotNull()
    regressed = F.coalesce((cand_render - base_render) < F.lit(-limits.allowed_render_regression), F.lit(False))
    higher = F.coalesce(cand_score > base_score, F.lit(False))
    lower = F.coalesce(cand_score < base_score, F.lit(False))

    improved = losses_known & (loss_gain >= limits.min_loss_delta) & ~regressed
    near = losses_known & ~improved & (F.abs(loss_gain) <= limits.tie_loss_delta)
    worse = losses_known & ~improved & ~near & (loss_gain < 0)

    by_loss = (
        F.when(improved, "candidate")
        .when(losses_known & regressed, "baseline")
        .when(near & higher, "candidate")
        .when(near & lower, "baseline")
        .when(worse, "baseline")
        .otherwise("tie")
    )
    open_still = by_loss == "tie"
    decision = F.when(~open_still, by_loss).when(regressed, "baseline").when(higher, "candidate").when(lower, "baseline").otherwise("tie")

    rationale = F.array_compact(F.array(
        F.when(losses_known, F.format_string("loss_delta=%.6f", loss_gain)),
        F.when(losses_known & regressed, RENDER_REGRESSED),
        F.when(improved, LOSS_IMPROVED),
        F.when(near & ~regressed & higher, TIED_CANDIDATE),
        F.when(near & ~regressed & lower, TIED_BASELINE),
        F.when(worse, LOSS_REGRESSED),
        F.when(open_still & regressed, RENDER_REGRESSED),
        F.when(open_still & ~regressed & higher, SCORE_CANDIDATE),
        F.when(open_still & ~regressed & lower, SCORE_BASELINE),
    ))
    return F.struct(decision.alias("decision"), rationale.alias("rationale"))
