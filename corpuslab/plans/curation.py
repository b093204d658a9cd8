"""The curation loop: rebuild, audit, collect ratings, apply them. Each step writes a new version."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import audit, canonical, code, curation, pages
from corpuslab.sources import records, source_tree

# Tags of the shard families (fixed values).
GOLD_LOCAL = ("tier:gold", "source:local")
GOLD_DOCS = ("tier:gold", "source:docs")
SILVER_LOCAL = ("tier:silver", "source:local")
SILVER_REPO = ("tier:silver", "source:repo")


def rebuild_canonical(
    spark: SparkSession, shards: Sequence[tuple[str, Sequence[str]]], path: str, rejected: DataFrame | None = None
) -> DataFrame:
    """Read the shard files in order, rebuild and write the canonical dataset; returns what was written.

    Fields of the shards that the schema does not know stay in the written records.
    """
    read = [(records.read_open_cases(spark, shard), tags) for shard, tags in shards]
    records.write_records(canonical.rebuild(read, rejected), path)
    return records.read_cases(spark, path)


def audit_shard(candidates: DataFrame, known: DataFrame | None = None, min_tags: int = 5) -> DataFrame:
    """All findings on a candidate shard, the rules on parsed code included."""
    profiled = code.profile(candidates, "completion")
    return audit.audit(profiled, known, min_tags, profiled=True)


def _batch(path: str) -> str:
    """The name of the batch that a plan appends: that of the new version it writes, so a plan that runs again has the same one."""
    return hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]


def apply_review(
    spark: SparkSession, dataset_path: str, ratings: DataFrame, new_path: str,
    log_path: str, archive_path: str, review_path: str = "",
    log: DataFrame | None = None, archive: DataFrame | None = None,
) -> dict[str, Any]:
    """Apply decisions: the dataset without rejects goes to ``new_path``; log and archive are appended to.

    What was applied and archived before is read from those two, where they exist, unless tables are given.

    The archive and the log are written before the new dataset version, so a job that dies half way
    leaves the old version in place and nothing lost. Both appends are the batch of ``new_path``: run again, the
    plan does not see its own batch as applied before, and replaces it.
    """
    batch = _batch(new_path)
    dataset = records.read_open_cases(spark, dataset_path)
    log = records.appended_ids(spark, log_path, but=batch) if log is None else log
    archive = records.appended_ids(spark, archive_path, but=batch) if archive is None else archive
    applied = curation.apply_decisions(dataset, ratings, log, archive, review_path)
    records.append_once(applied.archived, archive_path, batch)
    records.append_once(applied.log_entries, log_path, batch)
    records.write_records(applied.dataset, new_path)
    summary = curation.review_summary(ratings, dataset).first().asDict()
    return {"input_path": dataset_path, "review_path": review_path, "output_path": new_path, **summary}


def promote_candidates(
    spark: SparkSession, candidates_path: str, ratings: DataFrame, promoted_path: str, remaining_path: str,
    promoted: DataFrame | None = None,
) -> dict[str, Any]:
    """Append approved candidates to the promoted set and write what is left of the shard.

    Ids that the promoted set holds already are refused; it is read from its path unless a table is given. What is
    appended is the batch of ``remaining_path``, which a plan that runs again replaces.
    """
    batch = _batch(remaining_path)
    candidates = records.read_open_cases(spark, candidates_path)
    promoted = records.appended_ids(spark, promoted_path, but=batch) if promoted is None else promoted
    result = curation.promote(candidates, ratings, promoted)
    records.append_once(result.promoted, promoted_path, batch)
    records.write_records(result.remaining, remaining_path)
    counts = candidates.join(
        curation.approved_ids(ratings).withColumn("_approved", F.lit(True)), "case_id", "left"
    ).agg(F.count("_approved").alias("num_promoted"), F.count_if(F.col("_approved").isNull()).alias("num_remaining_candidates"))
    return counts.first().asDict()


def import_documentation(manifest: DataFrame, page_table: DataFrame, strict: bool = True) -> DataFrame:
    """Cases from documentation pages; with ``strict`` a row that cannot be imported raises."""
    from corpuslab.operators import keys

    imported = pages.import_pages(manifest, page_table)
    if strict:
        keys.require_empty(pages.manifest_violations(manifest), "Manifest entries with missing keys")
        keys.require_empty(imported.filter(F.col("problem").isNotNull()).select("case_id"), "Pages that give no example")
    return imported.drop("problem") if strict else imported


def import_repositories(spark: SparkSession, checkouts: Sequence[tuple[str, dict]]) -> DataFrame:
    """Scene cases of checked-out repositories: ``(folder, manifest entry)`` pairs."""
    tables = [source_tree.read_repository(spark, folder, entry) for folder, entry in checkouts]
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return code.scene_cases(merged)


def split_candidates(imported: DataFrame, path: str) -> DataFrame:
    """Write plain and custom candidates apart in one pass; returns the custom-library breakdown."""
    flagged = curation.candidate_flag(imported)
    records.write_records(flagged, path, partition_by=["candidate_set"])
    return curation.import_breakdown(flagged.filter(F.col("candidate_set") == "custom"))
