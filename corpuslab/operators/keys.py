"""Key checks. Each returns the offending rows; ``require_empty`` turns them into an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A check found rows it must not find."""


def require_empty(violations: DataFrame, label: str, preview: int = 10) -> None:
    """Raise naming up to ``preview`` offending keys, in order, when there are any."""
    key = violations.columns[0]
    found = [row[0] for row in violations.select(F.col(key).cast("string")).distinct().orderBy(key).limit(preview + 1).collect()]
    if found:
        shown = ", ".join(str(v) for v in found[:preview])
        raise CheckFailed(f"{label}: {shown}" + (", ..." if len(found) > preview else ""))


def gate(facts: DataFrame, key: str, faults: Mapping[str, str], repeated: str, empty: str | None = None) -> None:
    """Check a table in one pass over narrow facts: the key, ``kept`` and a boolean column per fault.

    Raises when a fault column is true, when nothing is kept (given a message for it) or when a kept
    key repeats, in that order. Facts are combined per key before the shuffle; the offending keys are
    read by a second job, and only when there are any.
    """
    per_key = facts.groupBy(key).agg(
        F.count_if("kept").alias("n_kept"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in faults]
    )
    totals = per_key.agg(
        F.coalesce(F.sum("n_kept"), F.lit(0)).alias("n_kept"),
        F.count_if(F.col("n_kept") > 1).alias("n_repeated"),
        *[F.count_if(c).alias(c) for c in faults],
    ).first()
    for column, label in faults.items():
        if totals[column]:
            require_empty(per_key.filter(column).select(key), label)
    if empty is not None and not totals["n_kept"]:
        raise CheckFailed(empty)
    if totals["n_repeated"]:
        require_empty(per_key.filter(F.col("n_kept") > 1).select(key), repeated)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys held by more than one row, with how many; counted before the shuffle, on the keys alone."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def unknown_refs(refs: DataFrame, known: DataFrame, key: str = "case_id") -> DataFrame:
    """Distinct referenced keys that the known table lacks."""
    return refs.select(key).distinct().join(known.select(key), key, "left_anti")


def already_present(refs: DataFrame, *tables: DataFrame, key: str = "case_id") -> DataFrame:
    """Distinct referenced keys found in any of the tables (decision log, promoted set, archive, ...)."""
    seen = tables[0].select(key)
    for table in tables[1:]:
        seen = seen.unionByName(table.select(key))
    return refs.select(key).distinct().join(seen, key, "left_semi")


def without_keys(df: DataFrame, removed: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows whose key is not among the removed ones. The removed side is cut to its key, and Spark
    broadcasts it only when its size is under the session's threshold."""
    return df.join(removed.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def excluded_ids(tables: Sequence[DataFrame], key: str = "case_id") -> DataFrame:
    """Distinct non-blank keys over several rating tables."""
    merged = tables[0].select(key)
    for table in tables[1:]:
        merged = merged.unionByName(table.select(key))
    return merged.filter(F.col(key) != "").distinct()
