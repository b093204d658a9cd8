"""Exact seeded train/valid/test split without a global sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import tags as tag_functions

PREFIX = 4
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class SplitSpec:
    """Fractions and seed (fixed defaults)."""

    train_fraction: float = 0.8
    valid_fraction: float = 0.1
    seed: int = 42

    def counts(self, rows: int) -> tuple[int, int, int]:
        """Sizes of the three splits: each holds at least one row."""
        if rows < 3:
            raise ValueError("Need at least three cases to create train/valid/test splits.")
        train = min(max(1, int(rows * self.train_fraction)), rows - 2)
        valid = min(max(1, int(rows * self.valid_fraction)), rows - train - 1)
        return train, valid, rows - train - valid


def order_hash(key: Column, seed: int) -> Column:
    """The pseudo-random position of a key: the same on every engine and for every partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def _histogram(hashes: DataFrame, start: int) -> list[tuple[str, int]]:
    """Rows per next four hex digits: never more than 65,536 rows per prefix come to the driver."""
    prefix = F.substring("h", 1, start + PREFIX)
    rows = hashes.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((row["p"], row["n"]) for row in rows)


def _locate(histogram: list[tuple[str, int]], within: str, position: int) -> tuple[str, int, int]:
    """Bucket holding the row at ``position``, the position inside it, and its size."""
    for prefix, size in histogram:
        if not prefix.startswith(within):
            continue
        if position < size:
            return prefix, position, size
        position -= size
    raise ValueError("position beyond the last row")


def _cut_points(hashes: DataFrame, spec: SplitSpec) -> tuple[str, str]:
    """The hashes of the first validation row and the first test row.

    Radix select: count by prefix, keep the bucket each cut falls in, and look only into those until
    they are small enough to read. Both cuts are refined in the same jobs.
    """
    histogram = _histogram(hashes, 0)
    train, valid, _ = spec.counts(sum(n for _, n in histogram))
    found = [_locate(histogram, "", train), _locate(histogram, "", train + valid)]
    depth = PREFIX
    while max(size for _, _, size in found) > BUCKET_ROWS and depth < 64:
        prefixes = {prefix for prefix, _, _ in found}
        histogram = _histogram(hashes.filter(_starts_with(prefixes)), depth)
        found = [_locate(histogram, prefix, position) for prefix, position, _ in found]
        depth += PREFIX
    prefixes = {prefix for prefix, _, _ in found}
    if depth >= 64:
        return found[0][0], found[1][0]
    rows = sorted(row["h"] for row in hashes.filter(_starts_with(prefixes)).collect())
    cuts = [[h for h in rows if h.startswith(prefix)][position] for prefix, position, _ in found]
    return cuts[0], cuts[1]


def _starts_with(prefixes) -> Column:
    ranges = [F.col("h").startswith(prefix) for prefix in sorted(prefixes)]
    condition = ranges[0]
    for other in ranges[1:]:
        condition = condition | other
    return condition


def exact_split(df: DataFrame, spec: SplitSpec = SplitSpec(), key: str = "case_id", out: str = "split") -> DataFrame:
    """Add the split of each row. The keys must be unique and not null.

    The cuts are found over the hashed keys alone, which are kept while that takes, so the table is read
    once for them whatever its format. The rows themselves are not shuffled: the split is a comparison
    with two constants, so it fuses with the scan and with whatever writes the result.
    """
    hashes = df.select(order_hash(F.col(key), spec.seed).alias("h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first_valid, first_test = _cut_points(hashes, spec)
    finally:
        hashes.unpersist()
    position = order_hash(F.col(key), spec.seed)
    return df.withColumn(
        out, F.when(position < first_valid, "train").when(position < first_test, "valid").otherwise("test")
    )


def split_variant(df: DataFrame, exclude: Sequence[str], split: str = "split") -> DataFrame:
    """Drop rows with an excluded tag from train and valid; test stays as it is."""
    return df.filter((F.col(split) == "test") | tag_functions.matches(F.col("tags"), exclude=exclude))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))


def split_manifest(
    df: DataFrame, source: str, spec: SplitSpec, include: Sequence[str] = (), exclude: Sequence[str] = (), split: str = "split"
) -> DataFrame:
    """One row: source, seed, filter and the count of each split."""
    def count_of(name: str) -> Column:
        return F.count_if(F.col(split) == name).alias(name)

    return df.agg(count_of("train"), count_of("valid"), count_of("test")).select(
        F.lit(source).alias("source_dataset"),
        F.lit(spec.seed).cast("bigint").alias("split_seed"),
        tag_functions.string_array(include).alias("include_tags"),
        tag_functions.string_array(exclude).alias("exclude_tags"),
        "train", "valid", "test",
    )
