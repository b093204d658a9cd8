"""Text shards in parquet, with one shard pinned for validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_shards(spark: SparkSession, paths: str | Sequence[str], validation_file: str, text: str = "text") -> DataFrame:
    """The text of every shard, with its name and its split.

    A shard is a ``*.parquet`` file, or a folder of that name with part files in it, as Spark writes one. Only the text
    column is read, and a filter on ``split`` or ``shard`` skips whole files.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.schema(f"{text} string").option("pathGlobFilter", "*.parquet").parquet(*listed)
    # The path is encoded as in a URI, where a plus sign stands for itself.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    shard = F.regexp_extract(path, r"([^/]+\.parquet)(?:/[^/=]+=[^/]*)*(?:/[^/]+)?$", 1)
    return rows.select(text, shard.alias("shard"), F.when(shard == validation_file, "val").otherwise("train").alias("split"))


def train_text(shards: DataFrame) -> DataFrame:
    return shards.filter(F.col("split") == "train")


def validation_text(shards: DataFrame) -> DataFrame:
    return shards.filter(F.col("split") == "val")
