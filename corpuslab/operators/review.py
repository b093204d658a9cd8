"""Blind pair sessions, sample sessions and what their ratings say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import first_truthy, slug
from corpuslab.operators import keys, ordered

PAIR_VERDICTS = ("A", "B", "both_good", "both_bad", "skip")
SAMPLE_DECISIONS = ("promote", "reject", "skip")
RENDERS_FAILED = "one_or_more_renders_failed"


def paired_runs(
    left: DataFrame, right: DataFrame, columns: Sequence[str], limit: int | None = None, required: bool = False
) -> DataFrame:
    """Cases both runs hold, with each side's columns prefixed ``left_`` and ``right_``.

    ``limit`` takes the first cases by id; with ``required`` two runs that share no case are an error.
    """
    l = left.select("case_id", *[F.col(c).alias(f"left_{c}") for c in columns])
    r = right.select("case_id", *[F.col(c).alias(f"right_{c}") for c in columns])
    pairs = l.join(r, "case_id")
    if required:
        shared = l.select("case_id").join(r.select("case_id"), "case_id", "left_semi")
        if shared.isEmpty():
            raise keys.CheckFailed("The two runs share no case.")
    return pairs if limit is None else ordered.row_slice(pairs, ["case_id"], 0, limit)


def resolved_labels(
    left_label: str | None, right_label: str | None, left_run: str | None, right_run: str | None, left_stem: str, right_stem: str
) -> tuple[str, str]:
    """Labels of the two sides; when they would be equal, unlabelled sides use their file stem."""
    left = left_label or left_run or left_stem
    right = right_label or right_run or right_stem
    if left == right:
        return left_label or left_stem, right_label or right_stem
    return left, right


def prompt_backfill(pairs: DataFrame, split_prompts: DataFrame | None = None) -> DataFrame:
    """First truthy of the left prompt, the right prompt and the prompt the split holds, else blank."""
    known = [F.col("left_prompt"), F.col("right_prompt")]
    if split_prompts is not None:
        pairs = pairs.join(split_prompts.select("case_id", F.col("prompt").alias("_split_prompt")), "case_id", "left")
        known.append(F.col("_split_prompt"))
    return pairs.withColumn("prompt", F.coalesce(first_truthy(*known), F.lit(""))).drop("_split_prompt")


def left_goes_first(case_id: Column, seed: int = 42) -> Column:
    """Whether the left option takes slot A: the parity of the first hex digit of the item's hash."""
    digit = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), case_id), 256), 1, 1), 16, 10).cast("int")
    return digit % 2 == 0


def blind_session(pairs: DataFrame, left_label: str, right_label: str, seed: int = 42, include_failed: bool = False) -> DataFrame:
    """Session rows: ``review_id``, two options in blind order and, where it is left out, why.

    ``pairs`` is what ``paired_runs`` and ``prompt_backfill`` give, with at least scene_name,
    syntax_ok, render_ok and weighted_score on both sides.
    """
    def option(side: str, label: str) -> Column:
        return F.struct(
            F.lit(label).alias("label"), F.lit(side).alias("source_side"),
            *[F.col(f"{side}_{c}").alias(c) for c in ("scene_name", "syntax_ok", "render_ok", "weighted_score")],
        )

    left, right = option("left", left_label), option("right", right_label)
    first = F.when(F.col("_left_first"), left).otherwise(right)
    second = F.when(F.col("_left_first"), right).otherwise(left)
    slotted = F.array(*[
        F.struct(F.lit(slot).alias("slot"), *[o[c].alias(c) for c in ("label", "source_side", "scene_name", "syntax_ok", "render_ok", "weighted_score")])
        for slot, o in (("A", first), ("B", second))
    ])
    both = F.coalesce(F.col("left_render_ok"), F.lit(False)) & F.coalesce(F.col("right_render_ok"), F.lit(False))
    reason = F.lit(None).cast("string") if include_failed else F.when(~both, RENDERS_FAILED)
    return pairs.withColumn("_left_first", left_goes_first(F.col("case_id"), seed)).select(
        slug(F.col("case_id")).alias("review_id"), "case_id", "prompt", slotted.alias("options"), reason.alias("skip_reason")
    )


def session_items(session: DataFrame) -> DataFrame:
    return session.filter(F.col("skip_reason").isNull()).drop("skip_reason")


def session_skipped(session: DataFrame) -> DataFrame:
    return session.filter(F.col("skip_reason").isNotNull()).select("case_id", F.col("skip_reason").alias("reason"))


def sample_session(batch: DataFrame) -> DataFrame:
    """Session rows for single samples: one option per case."""
    option = F.struct(
        F.lit("sample").alias("slot"), F.lit("sample").alias("label"),
        F.col("entry_scene").alias("scene_name"), F.col("render_ok"), F.col("render_log_tail"),
    )
    return batch.select(
        slug(F.col("case_id")).alias("review_id"), "case_id", F.coalesce("prompt", F.lit("")).alias("prompt"),
        "tags", F.array(option).alias("options"),
    )


def review_batch(cases: DataFrame, rated: Sequence[DataFrame], offset: int = 0, limit: int = 0) -> DataFrame:
    """Cases no earlier rating names, in id order, from ``offset`` on; a limit of 0 means all."""
    open_cases = keys.without_keys(cases, keys.excluded_ids(rated)) if rated else cases
    return ordered.row_slice(open_cases, ["case_id"], offset, limit)


def slot_field(options: Column, slot: str, field: str) -> Column:
    return F.get(F.filter(options, lambda o: o["slot"] == slot), F.lit(0))[field]


def rating_records(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pair ratings with their labels back: the preferred label is null for ties and skips."""
    options = F.col("options")
    joined = ratings.join(items.select("review_id", "case_id", "prompt", "options"), "review_id")
    slots = joined.select(
        "review_id", "case_id", "prompt", "verdict", "confidence", F.trim(F.coalesce("notes", F.lit(""))).alias("notes"),
        slot_field(options, "A", "label").alias("slot_a_label"), slot_field(options, "B", "label").alias("slot_b_label"),
        slot_field(options, "A", "render_ok").alias("slot_a_render_ok"), slot_field(options, "B", "render_ok").alias("slot_b_render_ok"),
    )
    return slots.withColumns({
        "preferred_label": F.when(F.col("verdict") == "A", F.col("slot_a_label")).when(F.col("verdict") == "B", F.col("slot_b_label")),
        "preferred_slot": F.when(F.col("verdict").isin("A", "B"), F.col("verdict")),
    })


def preference_wins(records: DataFrame) -> DataFrame:
    """How often each label was preferred, out of the ratings it appeared in."""
    shown = records.select(
        F.explode(F.array("slot_a_label", "slot_b_label")).alias("label"), "preferred_label",
    )
    return shown.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_shown"),
        F.count_if(F.col("preferred_label") == F.col("label")).alias("n_wins"),
        F.count_if(F.col("preferred_label").isNull()).alias("n_undecided"),
    )


def public_items(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """What a reviewer may see: labels and scores hidden, and whether the item is rated."""
    rated = ratings.select("review_id").distinct().withColumn("_rated", F.lit(True))
    hidden = F.transform("options", lambda o: F.struct(
        o["slot"].alias("slot"), o["render_ok"].alias("render_ok"), o["scene_name"].alias("scene_name")
    ))
    return items.join(rated, "review_id", "left").select(
        "review_id", "case_id", "prompt", F.coalesce("_rated", F.lit(False)).alias("rated"), hidden.alias("options")
    )


def session_progress(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row: items in the session, distinct rated ids, and how many remain (never negative)."""
    per_side = items.select(F.lit(1).alias("is_item"), F.lit(None).cast("string").alias("rated_id")).unionByName(
        ratings.select(F.lit(0).alias("is_item"), F.col("review_id").alias("rated_id")).distinct()
    )
    return per_side.agg(
        F.coalesce(F.sum("is_item"), F.lit(0)).alias("total"), F.count("rated_id").alias("rated")
    ).withColumn("remaining", F.greatest(F.col("total") - F.col("rated"), F.lit(0)))
