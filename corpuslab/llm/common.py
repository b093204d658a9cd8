"""What several operators of this package share: fresh column names, samples, id filters, components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import checkpointed, released

# A filter of ids is never larger than this, whatever the number of ids (bits; 2 MB).
FILTER_BITS = 1 << 24
# Copies of one key beyond this share of all rows are joined through a broadcast of at most 1 / share keys.
HEAVY_SHARE = 1 / 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_of(key: Column, digest: Column) -> Column:
    """A text that names a row by its id, which may be null, and the digest of its text."""
    return F.concat(F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-")), F.lit(":"), F.coalesce(digest, F.lit("")))


def bounded_sample(rows: DataFrame, stratum: Column, key: str, size: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """At most ``max_rows`` rows and ``max_bytes`` bytes of each stratum, in the order of a hash of the key, one row of each key.

    Only (stratum, hash, size) of the keys below a threshold that lets about twice ``max_rows`` pass is ordered; a key
    with many rows is one of these, of whose rows that of the least hash is taken, before any shuffle. Rows are joined
    to the chosen keys. Null strata and null keys are left out.
    """
    facts = rows.select(stratum.alias("_stratum"), F.col(key).alias("_key"), size.alias("_size")).where(
        F.col("_stratum").isNotNull() & F.col("_key").isNotNull()
    )
    counts = {r["_stratum"]: r["n"] for r in facts.groupBy("_stratum").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    draw = F.shiftrightunsigned(F.xxhash64("_key", F.lit("sample")), 11).cast("double") / float(1 << 53)
    passing = F.lit(False)
    for value, n in counts.items():
        passing = passing | ((F.col("_stratum") == F.lit(value)) & (F.col("_draw") < F.lit(min(1.0, 2.0 * max_rows / n))))
    drawn = facts.withColumn("_draw", draw).where(passing).groupBy("_stratum", "_draw", "_key").agg(F.max("_size").alias("_size")).collect()
    chosen, rows_of, bytes_of = [], {}, {}
    for r in sorted(drawn, key=lambda r: (str(r["_stratum"]), r["_draw"], str(r["_key"]))):
        k, n = r["_stratum"], r["_size"] or 0
        if rows_of.get(k, 0) < max_rows and (bytes_of.get(k, 0) + n <= max_bytes or not rows_of.get(k)):
            rows_of[k], bytes_of[k] = rows_of.get(k, 0) + 1, bytes_of.get(k, 0) + n
            chosen.append((k, r["_key"]))
    of, at, one = fresh(rows, "_of", "_at", "_one")
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema.fields}
    keys = rows.sparkSession.createDataFrame(chosen, f"{of} {kinds['_stratum']}, {at} {kinds['_key']}")
    taken = rows.join(F.broadcast(keys), (stratum == F.col(of)) & (F.col(key) == F.col(at)), "left_semi")
    columns = [F.col(f"`{c}`") for c in rows.columns]
    hashed = [c for c, (_, kind) in zip(columns, rows.dtypes, strict=True) if "map<" not in kind and "variant" not in kind]
    least = F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias(one)
    return taken.groupBy(stratum.alias(of), F.col(key).alias(at)).agg(least).select(f"{one}.*")


def arrow_slices(column: pa.Array, kind: pa.DataType = pa.large_string(), most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes, or of one longer row. Null is empty."""
    column = column.cast(kind).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        high = min(high, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def give_back() -> None:
    """Returns freed memory to the system at the end of a Python task: workers live on into stages of the JVM alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def maybe_in(ids: DataFrame, key: str = "doc_id"):
    """A column function that is true for every one of ``ids`` and for few other keys: a Bloom filter.

    It spares rows a shuffle before an exact join. Its size follows the number of ids up to FILTER_BITS, so
    what is broadcast is bounded; beyond that more rows pass, and the join stays exact.
    """
    spark = ids.sparkSession
    count = ids.count()
    bits = 1 << max(12, min(FILTER_BITS.bit_length() - 1, int(count * 16).bit_length()))
    place = lambda seed, c: F.xxhash64(c, F.lit(seed)).bitwiseAND(F.lit(bits - 1))
    words = (
        ids.select(F.explode(F.array(place(1, F.col(key)), place(2, F.col(key)), place(3, F.col(key)))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
    )
    filled = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    filled[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def passes(*places):
        import pandas as pd

        out = None
        for p in places:
            at = p.to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            out = hit if out is None else out & hit
        return pd.Series(out.astype(bool))

    return lambda c: passes(place(1, c), place(2, c), place(3, c))


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of rows to one row per key, whose ``weight`` says how many rows there are.

    Keys that hold over HEAVY_SHARE of ``total`` rows, at most 1 / HEAVY_SHARE of them by arithmetic, are
    broadcast, so that none of their rows is shuffled; all others meet through a shuffle.
    """
    limit = max(1000, int(total * HEAVY_SHARE))
    heavy = keyed.where(F.col(weight) > limit).withColumn("_heavy", F.lit(True))
    names = [c for c in keyed.columns if c != key]
    seen = rows.join(F.broadcast(heavy.select(key, "_heavy", *[F.col(c).alias(f"_h_{c}") for c in names])), key, "left")
    hot = seen.where(F.col("_heavy")).select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in names])
    rest = seen.where(F.col("_heavy").isNull()).select(*rows.columns)
    return hot.unionByName(rest.join(keyed.where(F.col(weight) <= limit), key, "left"))


def compact(rows: DataFrame, count: int, each: int = 50_000) -> DataFrame:
    """``rows``, of which there are about ``count``, in no more partitions than ``each`` of them to a task ask for, but enough for all cores."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // each)))


def fresh(taken: DataFrame | list[str], *names: str) -> list[str]:
    """``names``, with underscores in front as far as a column has the name already, whatever its case."""
    columns = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    out = []
    for name in names:
        while name.lower() in columns:
            name = f"_{name}"
        columns.add(name.lower())
        out.append(name)
    return out


def settled(rows: DataFrame, count: int, each: int = 50_000) -> DataFrame:
    """A checkpoint of ``rows``, of which there are about ``count``, that is read in few partitions.

    The rows are made in all partitions that they come in: a task that made many of these would hold all their sorters.
    """
    return compact(checkpointed(rows), count, each)


def wrapped(rows: DataFrame, *names: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with all their columns, but those named in ``without``, in one struct ``_user``, and ``names`` beside it.

    Whatever columns are added then, none of the user's can clash with them; ``_user.*`` brings these back.
    """
    own = [F.col(f"`{c}`") for c in rows.columns if c not in without]
    return rows.select(F.struct(*own).alias("_user"), *names)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected ``edges`` (a, b): root is the smallest id of its component.

    Each round every node takes the smallest root among its neighbours' and then its root's root, until
    nothing changes. Minima are combined before each shuffle; a hub's rows are split by adaptive execution.
    """
    there = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    count = there.count()
    there = compact(there, count)
    both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
    roots = settled(roots, 2 * count)
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        taken = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = taken.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root"))
        jumped = settled(jumped, 2 * count)
        released(roots)
        roots = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            released(there)
            return roots


def only(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is one of ``ids`` (distinct); other rows are filtered before the shuffle. Null matches null."""
    keys = checkpointed(ids.select(F.col(key).alias("_id")))
    near = maybe_in(keys, "_id")
    return rows.where(near(F.col(key))).join(keys, F.col(key).eqNullSafe(F.col("_id")), "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is none of ``ids`` (distinct); what surely isn't one is never shuffled. Null matches null."""
    keys = checkpointed(ids.select(F.col(key).alias("_id")))
    near = maybe_in(keys, "_id")
    far = rows.where(~near(F.col(key)))
    return far.unionByName(rows.where(near(F.col(key))).join(keys, F.col(key).eqNullSafe(F.col("_id")), "left_anti"))
