"""Review decisions applied to datasets: promotion, rejection and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import tags as tag_functions
from corpuslab.functions.text import first_truthy, strip
from corpuslab.operators import cases, keys

# Words that count as an approval (fixed values).
APPROVALS = ("promote", "approved", "approve", "keep", "good", "winner")
DECISION_FIELDS = ("decision", "label", "verdict", "rating")
ACTIONABLE = ("promote", "reject")


def decision_word(df: DataFrame) -> Column:
    """First truthy of the decision fields the table has, stripped and lower-cased."""
    present = [F.col(c).cast("string") for c in DECISION_FIELDS if c in df.columns]
    return F.lower(strip(F.coalesce(first_truthy(*present), F.lit(""))))


def approved_ids(ratings: DataFrame) -> DataFrame:
    """Distinct ids with an approval in any of the decision fields."""
    return ratings.filter(decision_word(ratings).isin(*APPROVALS)).select("case_id").distinct()


def actionable(ratings: DataFrame) -> DataFrame:
    """Ratings that say exactly ``promote`` or ``reject`` in ``decision``."""
    return ratings.filter(F.col("decision").isin(*ACTIONABLE))


@dataclass(frozen=True)
class Applied:
    """New versions to write: the dataset, the log rows to append and the archive rows to append."""

    dataset: DataFrame
    log_entries: DataFrame
    archived: DataFrame


def apply_decisions(
    dataset: DataFrame, ratings: DataFrame, log: DataFrame | None = None, archive: DataFrame | None = None,
    review_path: str = "", applied_at: Column | None = None, strict: bool = True,
) -> Applied:
    """Log actionable ratings, take rejected cases out of the dataset and archive them."""
    acted = actionable(ratings)
    rejected = acted.filter(F.col("decision") == "reject")
    if strict:
        if acted.select("case_id").isEmpty():
            raise keys.CheckFailed("No promote/reject decisions found in the review file.")
        keys.require_empty(keys.unknown_refs(acted, dataset), "Review file references unknown dataset case_ids")
        if log is not None:
            keys.require_empty(keys.already_present(acted, log), "Review decisions already applied for case_ids")
        if archive is not None:
            keys.require_empty(keys.already_present(rejected, archive), "Rejected cases already archived")
    def optional(name: str) -> Column:
        return F.col(name) if name in acted.columns else F.lit(None).cast("string")

    entries = acted.select(
        "case_id", "decision", optional("confidence").alias("confidence"),
        F.coalesce(optional("notes"), F.lit("")).alias("notes"),
        F.lit(review_path).alias("source_review_path"),
        (F.current_timestamp() if applied_at is None else applied_at).alias("applied_at"),
    )
    return Applied(
        dataset=keys.without_keys(dataset, rejected),
        log_entries=entries,
        archived=dataset.join(rejected.select("case_id").distinct(), "case_id", "left_semi"),
    )


@dataclass(frozen=True)
class Promotion:
    promoted: DataFrame
    remaining: DataFrame


def promote(
    candidates: DataFrame, ratings: DataFrame, promoted: DataFrame | None = None,
    tier: str = tag_functions.APPROVED_TIER, strict: bool = True,
) -> Promotion:
    """Approved candidates, retagged and licensed, and the candidates left over."""
    approved = approved_ids(ratings)
    if strict:
        if approved.isEmpty():
            raise keys.CheckFailed("No promotable review decisions found in the review file.")
        keys.require_empty(keys.unknown_refs(approved, candidates), "Review file references unknown candidate case_ids")
        if promoted is not None:
            keys.require_empty(keys.already_present(approved, promoted), "Candidate case_ids are already promoted")
    batch = cases.with_default_license(candidates.join(approved, "case_id", "left_semi"))
    return Promotion(
        promoted=batch.withColumn("tags", tag_functions.promoted(F.col("tags"), tier)),
        remaining=candidates.join(approved, "case_id", "left_anti"),
    )


def review_summary(ratings: DataFrame, dataset: DataFrame) -> DataFrame:
    """One row: decisions applied, promoted, rejected, and cases that remain in the dataset."""
    acted = actionable(ratings)
    kept = keys.without_keys(dataset, acted.filter(F.col("decision") == "reject"))
    rows = acted.select("decision").unionByName(kept.select(F.lit("_kept").alias("decision")))
    return rows.agg(
        F.count_if(F.col("decision") != "_kept").alias("num_decisions_applied"),
        F.count_if(F.col("decision") == "promote").alias("num_promoted"),
        F.count_if(F.col("decision") == "reject").alias("num_rejected"),
        F.count_if(F.col("decision") == "_kept").alias("num_remaining_dataset_cases"),
    )


def render_summary(rendered: DataFrame) -> DataFrame:
    return rendered.agg(
        F.count(F.lit(1)).alias("num_cases"), F.count_if(F.coalesce("render_ok", F.lit(False))).alias("num_rendered")
    )


def candidate_flag(df: DataFrame) -> DataFrame:
    """Add ``candidate_set``: ``plain``, or ``custom`` where the flag is false or unknown."""
    plain = F.coalesce(F.col("is_plain_manim_candidate"), F.lit(False))
    return df.withColumn("candidate_set", F.when(plain, "plain").otherwise("custom"))


def import_breakdown(df: DataFrame, column: str = "custom_imports") -> DataFrame:
    """Cases per custom import, ``none`` for cases without any; sorted by name."""
    names = F.explode_outer(column).alias("import_name")
    return (
        df.select(names).groupBy(F.coalesce("import_name", F.lit("none")).alias("import_name"))
        .agg(F.count(F.lit(1)).alias("n_cases")).orderBy("import_name")
    )


def source_counts(df: DataFrame) -> DataFrame:
    """Cases per source and revision; the row with both null is the grand total."""
    return df.groupingSets(
        [["source_name", "source_ref"], []], "source_name", "source_ref"
    ).agg(F.count(F.lit(1)).alias("case_count"))
