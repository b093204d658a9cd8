"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Texts are compared after each run of ASCII white space became one space. Every partition sorts its distinct
fingerprints and sends each owner of a fingerprint range its part, coded as gaps (quotients in unary, remainders
in fixed width). An owner decodes what all partitions sent, and answers each with a bitmap: which of the sorted
fingerprints occur elsewhere too, or were marked as repeated inside the partition. Only rows behind a set bit are
suspects; their texts alone are shuffled, to verify that texts of one SHA-256 are the same bytes.

Results by definition: a null text counts as empty, and empty texts are copies of one another. Of equal texts
the smallest id stays; null ids come last. Rows that share an id and a text are one document: all of them stay
or all go, and each counts in ``group_size``. An empty table gives an empty result. Two different texts with one
SHA-256 would stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.session import checkpointed

FINGERPRINT_BITS = 56
# Partitions and owners are as many as give a message about so many fingerprints: both grow with the root of the rows.
MESSAGE = 1024

_MESSAGES = "owner int, part int, n int, width int, quotients binary, remainders binary, repeated binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """(remainder width, quotients, remainders) of sorted distinct ``values`` below ``span``."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    width = max(0, (span // max(1, len(values))).bit_length() - 1)
    quotient = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.ones(int(quotient.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 0
    fixed = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return width, np.packbits(unary).tobytes(), np.packbits(fixed.astype(np.uint8)).tobytes()


def ungolomb(n: int, width: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * width].reshape(n, width).astype(np.uint64)
    remainder = (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(width)) + remainder)


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def _send(owner_bits: int):
    shift = np.uint64(FINGERPRINT_BITS - owner_bits)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = [], 0
        for b in batches:
            if len(b):
                held.append(b["fp"].to_numpy().astype(np.uint64))
                part = int(b["part"].iloc[0])
        if not held:
            return
        prints, times = np.unique(np.concatenate(held), return_counts=True)
        owner = (prints >> shift).astype(np.int64)
        rows = []
        for o in np.unique(owner):
            own = owner == o
            low = prints[own] & np.uint64((1 << int(shift)) - 1)
            rows.append((int(o), part, len(low), *golomb(low, 1 << int(shift)), _packed(times[own] > 1)))
        yield pd.DataFrame(rows, columns=["owner", "part", "n", "width", "quotients", "remainders", "repeated"])

    return send


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    lists = [ungolomb(m.n, m.width, m.quotients, m.remainders) for m in messages.itertuples()]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[times > 1]
    rows = []
    for m, own in zip(messages.itertuples(), lists, strict=True):
        repeated = np.unpackbits(np.frombuffer(m.repeated, np.uint8))[: m.n].astype(bool)
        rows.append((m.owner, m.part, _packed(np.isin(own, shared) | repeated)))
    return pd.DataFrame(rows, columns=["owner", "part", "bitmap"])


def _receive(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    prints, at = np.unique(rows["fp"].to_numpy().astype(np.uint64), return_inverse=True)
    flags = np.zeros(len(prints), bool)
    if len(prints) and len(bitmaps):
        owner = prints >> np.uint64(FINGERPRINT_BITS - int(bitmaps["owner_bits"].iloc[0]))
        for b in bitmaps.itertuples():
            low, high = np.searchsorted(owner, [b.owner, b.owner + 1])
            flags[low:high] = np.unpackbits(np.frombuffer(b.bitmap, np.uint8))[: high - low].astype(bool)
    return rows[["key", "digest"]][flags[at]]


def _suspects(facts: DataFrame, total: int) -> DataFrame:
    """(key, digest) of the rows whose fingerprint another row has too."""
    parts = ceil(sqrt(total / MESSAGE)) or 1
    owner_bits = (parts - 1).bit_length()
    # A checkpoint fixes which rows are of which part: were a part made again with others, its bitmaps would not fit.
    printed = facts.withColumn("fp", F.xxhash64("digest").bitwiseAND(F.lit((1 << FINGERPRINT_BITS) - 1))).coalesce(parts)
    fixed = checkpointed(printed.withColumn("part", F.spark_partition_id()))
    sent = fixed.select("fp", "part").mapInPandas(_send(owner_bits), _MESSAGES)
    answers = sent.groupBy("owner").applyInPandas(_answer, "owner int, part int, bitmap binary").withColumn("owner_bits", F.lit(owner_bits))
    kind = dict(facts.dtypes)["key"]
    return fixed.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_receive, f"key {kind}, digest binary")


def find_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    facts = checkpointed(docs.select(F.col(key).alias("key"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")))
    total = facts.count()
    suspects = checkpointed(_suspects(facts, total))
    texts = common.only(docs.select(F.col(key).alias("key"), text), suspects.select("key").distinct(), "key")
    body = texts.select(normalised(F.col(text)).alias("body"))
    # Equal bytes are one group here; grouping on the map side keeps copies out of the shuffle.
    proven = body.groupBy("body").agg(F.count("*").alias("n")).groupBy(F.unhex(F.sha2("body", 256)).alias("digest")).agg(F.count("*").alias("texts"))
    groups = (
        suspects.groupBy("digest").agg(F.min("key").alias("keep_id"), F.count("*").alias("group_size"))
        .join(proven, "digest")
        .select("digest", "keep_id", F.when(F.col("texts") > 1, F.raise_error(F.lit("different texts share a SHA-256"))).otherwise(F.col("group_size")).alias("group_size"))
        .where("group_size > 1")
    )
    placed = common.join_skewed(facts, checkpointed(groups), "digest", "group_size", total)
    return placed.select(
        F.col("key").alias(key),
        F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies that another row makes redundant; columns and kept rows are unchanged.

    A row goes by its id and its text: other texts of the same id, or of none, stay.
    """
    gone = checkpointed(find_copies(docs)).where(~F.col("kept")).select(common.row_of(F.col("doc_id"), F.col("text_sha256")).alias("_row"))
    marked = common.wrapped(docs, "doc_id", "text").withColumn("_row", common.row_of(F.col("doc_id"), F.sha2(normalised(F.col("text")), 256)))
    return common.without(marked, gone.distinct(), "_row").select("_user.*")
