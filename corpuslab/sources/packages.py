"""Dataset folders and export packages: the split files and their manifest."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import cases, splitting
from corpuslab.sources import records

SPLITS = ("train", "valid", "test")
EXPORT_SPLITS = ("train", "validation", "test")


def write_manifest(spark: SparkSession, manifest: dict[str, Any], path: str) -> None:
    """A one-row JSON file."""
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()["value"])


def _counted_write(df: DataFrame, path: str, split: str, names: Sequence[str]) -> dict[str, int]:
    """Write by split, as gzipped JSON lines; the rows of each are counted as they are written, so nothing is read again."""
    counts = Observation()
    watched = df.observe(counts, *[F.count_if(F.col(split) == name).alias(name) for name in names])
    watched.write.mode("overwrite").partitionBy(split).option("compression", "gzip").json(path)
    return {name: counts.get[name] for name in names}


def write_dataset(
    prepared: DataFrame, path: str, source: str, spec: splitting.SplitSpec,
    include: Sequence[str] = (), exclude: Sequence[str] = (), source_spec: dict[str, Any] | None = None,
) -> dict[str, Any]:
    """Chat records in ``<path>/records/split=<name>`` and the manifest in ``<path>/manifest``."""
    split = splitting.exact_split(cases.chat_records(prepared), spec)
    counts = _counted_write(split, f"{path}/records", "split", SPLITS)
    manifest = {
        "source_dataset": source,
        "source_dataset_spec": source_spec or {},
        "output_dir": path,
        "split_seed": spec.seed,
        "dataset_filter": {"include_tags": list(include), "exclude_tags": list(exclude)},
        "counts": counts,
    }
    write_manifest(prepared.sparkSession, manifest, f"{path}/manifest")
    return manifest


def write_variant(spark: SparkSession, source_path: str, path: str, exclude: Sequence[str], schema) -> dict[str, Any]:
    """A dataset folder without the excluded tags in train and valid; the test split stays as it is."""
    rows = spark.read.schema(schema).json(f"{source_path}/records")
    counts = _counted_write(splitting.split_variant(rows, exclude), f"{path}/records", "split", SPLITS)
    manifest = read_manifest(spark, f"{source_path}/manifest")
    manifest |= {"output_dir": path, "variant_exclude_tags": sorted(set(exclude)), "counts": counts}
    write_manifest(spark, manifest, f"{path}/manifest")
    return manifest


def write_export(
    prepared: DataFrame, path: str, source: str, spec: splitting.SplitSpec,
    include: Sequence[str] = (), exclude: Sequence[str] = (), **card: Any,
) -> dict[str, Any]:
    """Export package: ``cases`` unsplit, ``chat`` by split (valid renamed), both gzipped, and the package metadata."""
    spark = prepared.sparkSession
    export_records = cases.export_records(prepared)
    records.write_records(export_records, f"{path}/cases", compression="gzip")
    chat = splitting.exact_split(cases.chat_records(prepared), spec)
    counts = _counted_write(export_split_names(chat), f"{path}/chat", "split", EXPORT_SPLITS)
    metadata = {
        "source_dataset": source,
        "counts": {"cases": sum(counts.values()), "chat": counts},
        "split_seed": spec.seed,
        "dataset_filter": {"include_tags": list(include), "exclude_tags": list(exclude)},
        "repo_id": card.get("repo_id"),
        "pretty_name": card.get("pretty_name"),
        "license": card.get("license_name") or "mit",
        "license_name": card.get("license_label"),
        "license_link": card.get("license_link"),
        "languages": list(card.get("languages") or []),
        "task_categories": list(card.get("task_categories") or []),
        "size_categories": list(card.get("size_categories") or []),
        "tags": list(card.get("tags") or []),
    }
    write_manifest(spark, metadata, f"{path}/manifest")
    return metadata


def export_split_names(df: DataFrame, split: str = "split") -> DataFrame:
    """``valid`` is called ``validation`` in an export."""
    return df.withColumn(split, F.when(F.col(split) == "valid", "validation").otherwise(F.col(split)))
