"""The canonical dataset: shards in order, licence gate, reject drop, unique ids, provenance tags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import tags as tag_functions
from corpuslab.operators import cases, keys


def union_shards(shards: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """All shards as one table; each row carries its shard's position and tags."""
    tagged = [
        df.withColumn("_shard", F.lit(i)).withColumn("_shard_tags", tag_functions.string_array(extra))
        for i, (df, extra) in enumerate(shards)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def keep_unrejected(df: DataFrame, rejected: DataFrame | None) -> DataFrame:
    return df if rejected is None else keys.without_keys(df, rejected)


def with_curation_tags(df: DataFrame, source_tags: str = "_shard_tags") -> DataFrame:
    """Merge the shard's tags and the duration class into the tags of each row."""
    return df.withColumn(
        "tags", tag_functions.with_provenance(F.col("tags"), F.col(source_tags), F.col("target_duration_seconds"))
    )


def rebuild(
    shards: Sequence[tuple[DataFrame, Sequence[str]]], rejected: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """The canonical rows. The gates run in this order: licences of every shard row, then
    the reject drop, then unique ids among what is left."""
    merged = union_shards(shards)
    if strict:
        facts = merged.select("case_id", cases.lacks_license().alias("unlicensed"))
        if rejected is None:
            facts = facts.withColumn("kept", F.lit(True))
        else:
            dropped = rejected.select("case_id").distinct().withColumn("_dropped", F.lit(True))
            facts = facts.join(dropped, "case_id", "left").withColumn("kept", F.col("_dropped").isNull())
        keys.gate(
            facts, "case_id", {"unlicensed": "Missing row-level license metadata"},
            repeated="Duplicate case_id while rebuilding canonical dataset",
        )
    return with_curation_tags(keep_unrejected(merged, rejected)).drop("_shard", "_shard_tags")


def merge_shards(shards: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Union of case tables; a repeated id is an error, never merged."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
    if strict:
        keys.require_empty(keys.duplicate_keys(merged, "case_id"), "Duplicate case_id while merging")
    return merged
