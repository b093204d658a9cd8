"""Line dedup: windows of three consecutive lines that occurred before are removed.

Every three consecutive lines of a text are a window, hashed together; windows overlap. The first occurrence of a
window, by document id and then by position, stays; the lines that later occurrences cover are merged and removed,
so a repeated passage of any length of three lines or more goes whole. Hashes are 128 bits wide; they are counted
with a sum on the map side, very frequent windows are met by a broadcast of bounded size, and only texts that lose
lines are shuffled.

Results by definition: lines end at ``\\n`` and are compared as they are; windows of three empty lines are no windows.
Texts of fewer than three lines are unchanged; a null text stays null and has no lines. Null ids come last. Rows that
share an id are the same document: windows at the same position of each are one occurrence. Every row is returned
once, with n_lines, n_removed and the text that is left; other columns are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.session import checkpointed

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pos, window) of every window that holds a line with text."""
    body = lambda i: F.concat_ws("\n", F.slice("_lines", i + 1, WINDOW))
    starts = F.when(F.size("_lines") >= WINDOW, F.sequence(F.lit(0), F.size("_lines") - WINDOW))
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.unhex(F.md5(body(i))).alias("window"), (body(i) == "\n" * (WINDOW - 1)).alias("blank")))
    return docs.select("doc_id", _lines(text).alias("_lines")).select("doc_id", F.inline(each)).where(~F.col("blank")).drop("blank")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, starts): where later occurrences of windows begin."""
    all_windows = checkpointed(windows(docs))
    place = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "pos")
    repeated = all_windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    met = common.join_skewed(all_windows, checkpointed(repeated), "window", "n", all_windows.count())
    later = met.where(F.col("n").isNotNull() & ~((F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.pos") == F.col("pos"))))
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("_starts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and n_lines and n_removed (columns of these names are replaced)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = common.wrapped(docs, "doc_id", "text", without=("n_lines", "n_removed", "text"))
    starts = checkpointed(covered(docs))
    near = common.maybe_in(starts, "doc_id")
    hit = docs.where(near(F.col("doc_id"))).join(starts.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    rest = docs.where(~near(F.col("doc_id"))).withColumn("_starts", F.lit(None).cast("array<int>"))
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    lines = _lines("text")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1))
    return hit.unionByName(rest).withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("text").isNull() | F.col("_starts").isNull(), 0).otherwise(F.size(gone)).cast("long"),
        "text": F.when(F.col("_starts").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
    }).select(*[F.col("text") if c == "text" else F.col(f"_user.`{c}`") for c in columns], "n_lines", "n_removed")
