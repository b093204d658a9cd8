"""Order-dependent operators that never need one task to hold a whole key.

A plain window sends every row of a key to one task, so a key with a third of all rows is one
task's work. Here rows are range-partitioned by key and order, which splits a hot key over many
partitions; a chunk is what a partition holds of a key. Chunks are summarised, at most one summary
for each partition is carried forward, and the window runs inside a chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from corpuslab.session import checkpointed

# A slice from the start of at most so many rows is taken as a top-k.
TOP_ROWS = 10_000


def _carry(kind: str, frame) -> Column:
    if kind == "ordinal":
        return F.sum("_n").over(frame)
    if kind in ("min", "min_before"):
        return F.min(f"_{kind}").over(frame)
    return F.last(f"_{kind}").over(frame)


def prefixed(
    df: DataFrame, keys: Sequence[str], order: str, outputs: Mapping[str, tuple[str, str | None]], partitions: int | None = None
) -> DataFrame:
    """Add prefix columns over each key's rows in the order of a sortable, per-key unique column.

    ``outputs`` maps a new column to ``(kind, value column)``:

    * ``ordinal``: position within the key, from 1;
    * ``min``: minimum so far, this row included;
    * ``min_before``: minimum of the earlier rows;
    * ``previous``: value of the row before.

    Ranges hold about equally many rows, however the values of ``order`` lie; the rows are checkpointed,
    so both uses see the same ranges. Callers pass narrow rows.
    """
    keys = list(keys)
    by = [*[F.col(k) for k in keys], F.col(order)]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    chunked = checkpointed(ranged.withColumn("_chunk", F.spark_partition_id()))
    value_of = {kind: value for kind, value in outputs.values()}
    if len(value_of) != len(outputs):
        raise ValueError("each kind of prefix may be asked for once")

    partial = {
        "ordinal": lambda _: F.count(F.lit(1)).alias("_n"),
        "min": lambda v: F.min(v).alias("_min"),
        "min_before": lambda v: F.min(v).alias("_min_before"),
        "previous": lambda v: F.max_by(v, order).alias("_previous"),
    }
    summary = chunked.groupBy(*keys, "_chunk").agg(
        *[partial[kind](value) for kind, value in value_of.items()], F.count(F.lit(1)).alias("_rows"),
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_chunk").alias("_k_chunk"),
        *[_carry(kind, before).alias(f"_carry_{kind}") for kind in value_of],
    )
    condition = F.col("_chunk") == F.col("_k_chunk")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = chunked.join(carry, condition, "left")

    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    made = []
    for name, (kind, value) in outputs.items():
        carried = F.col(f"_carry_{kind}")
        if kind == "ordinal":
            column = F.row_number().over(inside).cast("bigint") + F.coalesce(carried, F.lit(0))
        elif kind == "min":
            column = F.least(F.min(value).over(so_far), carried)
        elif kind == "min_before":
            column = F.least(F.min(value).over(earlier), carried)
        else:
            column = F.when(F.row_number().over(inside) == 1, carried).otherwise(F.lag(value, 1).over(inside))
        made.append(column.alias(name))
    return joined.select(*df.columns, *made)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Position of each row within its keys in the given order, from 1.

    The rows are range-partitioned by keys and order, so a hot key is spread over many partitions,
    and checkpointed so that both uses see the same partitions. Only a key that continues from an
    earlier partition needs an offset: at most one per partition, which bounds the broadcast.
    """
    keys = list(keys)
    ranged = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(before))
        .filter(F.col("_offset") > 0)
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), "_offset")
    )
    condition = F.col("_part") == F.col("_k_part")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .join(offsets, condition, "left")
        .select(*df.columns, (F.col("_local").cast("bigint") + F.coalesce("_offset", F.lit(0))).alias(out))
    )


@dataclass(frozen=True)
class Key:
    """A sort key: nulls come first in ascending and last in descending order."""

    name: str
    descending: bool = False

    def sorted(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()

    def after(self, value: Column, none: bool) -> Column:
        """Whether a row's key comes after ``value``, which is null if ``none``."""
        if self.descending:
            return F.lit(False) if none else F.col(self.name).isNull() | (F.col(self.name) < value)
        return F.col(self.name).isNotNull() if none else F.col(self.name) > value

    def reached(self, row: Row, kinds: Mapping[str, str]) -> Column:
        """Whether this key alone comes after that of ``row`` or is the same: a plain comparison, which scans can use."""
        value = F.lit(row[self.name]).cast(kinds[self.name])
        if row[self.name] is None:
            return F.col(self.name).isNull() if self.descending else F.lit(True)
        return F.col(self.name).isNull() | (F.col(self.name) <= value) if self.descending else F.col(self.name) >= value

    def not_after(self, row: Row, kinds: Mapping[str, str]) -> Column:
        """Whether this key alone comes before that of ``row`` or is the same."""
        value = F.lit(row[self.name]).cast(kinds[self.name])
        if row[self.name] is None:
            return F.lit(True) if self.descending else F.col(self.name).isNull()
        return F.col(self.name) >= value if self.descending else F.col(self.name).isNull() | (F.col(self.name) <= value)


@dataclass(frozen=True)
class Boundary:
    """The keys of one row, how many rows come before it, and how many have its keys."""

    row: Row
    before: int
    ties: int


def _compared(keys: Sequence[Key], row: Row, kinds: Mapping[str, str]) -> tuple[Column, Column]:
    """Whether a row comes after ``row``, and whether it has its keys."""
    after, equal = F.lit(False), F.lit(True)
    for key in keys:
        value = F.lit(row[key.name]).cast(kinds[key.name])
        after = after | (equal & key.after(value, row[key.name] is None))
        equal = equal & F.col(key.name).eqNullSafe(value)
    return F.coalesce(after, F.lit(False)), equal


def _boundary(narrow: DataFrame, keys: Sequence[Key], counts: Sequence[Row], rank: int) -> Boundary | None:
    """The boundary at ``rank``, from 1; its keys are read from the one range that holds them."""
    before = 0
    for found in counts:
        if rank <= before + found["n"]:
            inside = Window.partitionBy("_part").orderBy(*[k.sorted() for k in keys])
            own = narrow.filter(F.col("_part") == found["_part"]).withColumn("_no", F.row_number().over(inside))
            row = own.filter(F.col("_no") == rank - before).first()
            after, equal = _compared(keys, row, dict(narrow.dtypes))
            got = narrow.agg(F.count_if(after).alias("a"), F.count_if(equal).alias("e"), F.count(F.lit(1)).alias("n")).first()
            return Boundary(row, got["n"] - got["a"] - got["e"], got["e"])
        before += found["n"]
    return None


def row_slice(df: DataFrame, order: Sequence[str | Key], offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order; a limit of 0 means all the rest. They come out sorted.

    A slice of few rows from the start is a plain top-k. Any other is cut out between two boundary rows: the keys alone
    are put in ranges, counted, and the boundaries read from the two ranges that hold them, so that the wide rows meet
    a filter on the keys, which reaches the scan, and are not moved but to sort what is left. Of rows with equal keys at
    a boundary as many belong to the slice as its size asks for, in the order of a hash of their contents; so a top-k
    and the slice that follows it share no row.
    """
    keys = [k if isinstance(k, Key) else Key(k) for k in order]
    return df if offset == 0 and limit == 0 else _cut(df, keys, offset, limit).orderBy(*[k.sorted() for k in keys])


def _cut(df: DataFrame, keys: Sequence[Key], offset: int, limit: int, last: bool = False) -> DataFrame:
    by, kinds = [k.sorted() for k in keys], dict(df.dtypes)
    if offset == 0 and limit <= TOP_ROWS:
        return df.orderBy(*by, *([] if last else _contents(df))).limit(limit)
    ranged = df.select(*[k.name for k in keys]).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    narrow = checkpointed(ranged)
    counts = sorted(narrow.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_part"])
    low = _boundary(narrow, keys, counts, offset) if offset else None
    high = _boundary(narrow, keys, counts, offset + limit) if limit else None
    if offset and low is None:
        return df.limit(0)
    if low and high and all(low.row[k.name] == high.row[k.name] for k in keys):
        return _tied(df, keys, high, offset - high.before, offset + limit - high.before, last)
    inside, ends = F.lit(True), []
    if low:
        after, _ = _compared(keys, low.row, kinds)
        inside = inside & keys[0].reached(low.row, kinds) & after
        ends.append(_tied(df, keys, low, offset - low.before, low.ties, last))
    if high:
        after, equal = _compared(keys, high.row, kinds)
        inside = inside & keys[0].not_after(high.row, kinds) & ~after & ~equal
        ends.append(_tied(df, keys, high, 0, offset + limit - high.before, last))
    found = df.filter(inside)
    for rows in ends:
        found = found if rows is None else found.unionByName(rows)
    return found


def _tied(df: DataFrame, keys: Sequence[Key], at: Boundary, skip: int, upto: int, last: bool) -> DataFrame | None:
    """The rows ``skip`` to ``upto`` of those with the boundary's keys, in the order of a hash; rows with one hash are any of them."""
    if skip >= upto:
        return None
    _, equal = _compared(keys, at.row, dict(df.dtypes))
    rows = df.filter(equal)
    if skip == 0 and upto == at.ties:
        return rows
    if last:
        return rows.limit(upto - skip)
    name = "_content"
    while name in [c.lower() for c in df.columns]:
        name = f"_{name}"
    rows = rows.withColumn(name, (*_contents(df), F.lit(0))[0])
    return _cut(rows, [Key(name)], skip, upto - skip, last=True).drop(name)


def _contents(df: DataFrame) -> list[Column]:
    """The hash of a row's contents, if it has columns that can be hashed."""
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.xxhash64(*hashed)] if hashed else []
