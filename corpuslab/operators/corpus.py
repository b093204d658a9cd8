"""Text for language modelling: budgets, pre-tokens, byte counts and bits per byte."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pre-token pattern (fixed value); the flag makes the classes Unicode-aware.
PRETOKEN_PATTERN = (
    "(?U)'(?i:[sdmt]|ll|ve|re)|[^\\r\\n\\p{L}\\p{N}]?+\\p{L}+|\\p{N}{1,2}| ?[^\\s\\p{L}\\p{N}]++[\\r\\n]*"
    "|\\s*[\\r\\n]|\\s+(?!\\S)|\\s+"
)
# Special tokens (fixed values); the first one starts every document.
SPECIAL_TOKENS = ("<|reserved_0|>", "<|reserved_1|>", "<|reserved_2|>", "<|reserved_3|>")

BUCKETS = 4_096
SMALL_BUCKET = 50_000


def capped(text: Column, cap: int | None) -> Column:
    return text if cap is None else F.substring(text, 1, cap)


def char_budget(
    docs: DataFrame, order: str, budget: int, text: str = "text", cap: int | None = None
) -> DataFrame:
    """Documents in order until their running length reaches the budget; the crossing one is included.

    ``cap``, if given, cuts each text to that many characters. A null text has length 0.

    ``order`` is an integral column. The result is a filter on it: the cut is found by summing lengths
    per range of ``order`` and looking again only inside the range where the budget is crossed, so no
    running total goes over the whole table and the driver sees at most ``BUCKETS`` sums per pass. The
    texts are read once for that; lengths are kept while it takes.
    """
    lengths = docs.select(F.col(order).alias("o"), F.coalesce(F.char_length(capped(F.col(text), cap)), F.lit(0)).cast("bigint").alias("n"))
    taken = docs.withColumn(text, capped(F.col(text), cap))
    lengths = lengths.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cut = _budget_cut(lengths, budget)
    finally:
        lengths.unpersist()
    return taken if cut is None else taken.filter(F.col(order) <= cut)


def _budget_cut(lengths: DataFrame, budget: int) -> int | None:
    """Largest order value inside the budget, or None when everything is."""
    low, high = lengths.agg(F.min("o"), F.max("o")).first()
    if low is None:
        return None
    spent = 0
    while True:
        width = (high - low) // BUCKETS + 1
        within = lengths.filter(F.col("o").between(low, high))
        sums = (
            within.groupBy(F.expr(f"(o - ({low}L)) div {width}L").alias("b"))
            .agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("rows")).collect()
        )
        crossing = None
        for row in sorted(sums, key=lambda r: r["b"]):
            if spent + row["chars"] >= budget:
                crossing = row
                break
            spent += row["chars"]
        if crossing is None:
            return None
        low = low + crossing["b"] * width
        high = min(high, low + width - 1)
        if width == 1:
            return low
        if crossing["rows"] <= SMALL_BUCKET:
            for row in within.filter(F.col("o").between(low, high)).groupBy("o").agg(F.sum("n").alias("n")).orderBy("o").collect():
                spent += row["n"]
                if spent >= budget:
                    return row["o"]


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN_PATTERN), F.lit(0))


def pretoken_counts(docs: DataFrame, text: str = "text", cap: int | None = None) -> DataFrame:
    """How often each pre-token occurs; counted per task before the shuffle, so a hot one is one row each."""
    return (
        docs.select(F.explode(pretokens(capped(F.col(text), cap))).alias("pretoken"))
        .groupBy("pretoken").agg(F.count(F.lit(1)).alias("n_uses"))
    )


def token_bytes(vocabulary: DataFrame, token: str = "token", special: Sequence[str] = SPECIAL_TOKENS) -> DataFrame:
    """Add ``n_bytes``: the UTF-8 length of a token, 0 for a special one."""
    return vocabulary.withColumn(
        "n_bytes", F.when(F.col(token).isin(*special), F.lit(0)).otherwise(F.octet_length(token)).cast("int")
    )


def bits_per_byte(losses: DataFrame, keys: Sequence[str] = (), nats: str = "nats", n_bytes: str = "n_bytes") -> DataFrame:
    """Nats over tokens that have bytes, per byte, in bits; tokens of no bytes count on neither side."""
    real = F.col(n_bytes) > 0
    totals = losses.groupBy(*keys).agg(
        F.sum(F.when(real, F.col(nats))).alias("total_nats"), F.sum(F.when(real, F.col(n_bytes))).cast("bigint").alias("total_bytes"),
    )
    return totals.withColumn("bits_per_byte", F.try_divide(F.col("total_nats"), F.ln(F.lit(2.0)) * F.col("total_bytes")))


def hashed_token_ids(text: Column, vocabulary_size: int) -> Column:
    """A stand-in encoding where no trained codec is at hand: each pre-token's hash, below the special ids."""
    slots = vocabulary_size - len(SPECIAL_TOKENS)
    return F.transform(pretokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int"))
