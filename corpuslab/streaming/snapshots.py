"""Keyed snapshots of a stream: small deltas by micro-batch, folded into a base now and then.

Layout below the path: ``delta/version=N`` holds the rows that changed in micro-batch N, ``base/version=N`` the newest row
of every key up to and with N. A reader takes the newest finished base and the deltas after it, so what it reads is bounded
by the keys and by EVERY deltas, however long the stream has run. When a base is finished, the deltas and bases that
neither it nor the one before needs are deleted: a reader that has just picked the older base can still finish, and a
micro-batch that is run again after a failure folds from the older base and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Micro-batches between two bases.
EVERY = 16


def _folder(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def versions(spark: SparkSession, path: str, finished: bool = False) -> list[int]:
    """The versions below ``path``, in order; ``finished`` leaves out folders whose writer has not committed."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and (not finished or files.exists(_folder(spark, f"{path}/{name}/_SUCCESS")[1])):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def _read(spark: SparkSession, path: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    bases = [v for v in versions(spark, f"{path}/base", finished=True) if below is None or v < below]
    deltas = [v for v in versions(spark, f"{path}/delta", finished=True) if v > max(bases, default=-1) and (below is None or v <= below)]
    rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
    for kind, wanted in (("base", bases[-1:]), ("delta", deltas)):
        if wanted:
            folders = [f"{path}/{kind}/version={v}" for v in wanted]
            rows = rows.unionByName(spark.read.schema(rows.schema).option("basePath", f"{path}/{kind}").parquet(*folders))
    return rows


def _newest(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    values = [f.name for f in schema.fields if f.name != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), "version").alias("s")).select(key, "s.*").select(*schema.names)


def latest(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The newest row of each key."""
    return _newest(_read(spark, path, schema), key, schema)


def publish(changed: DataFrame, version: int, path: str, key: str, every: int = EVERY) -> None:
    """Writes the rows of a micro-batch, one for each changed key, and folds the deltas when it is time."""
    spark, schema = changed.sparkSession, changed.schema
    changed.write.mode("overwrite").parquet(f"{path}/delta/version={version}")
    if (version + 1) % every:
        return
    folded = _newest(_read(spark, path, schema, below=version), key, schema)
    folded.write.mode("overwrite").parquet(f"{path}/base/version={version}")
    older = [v for v in versions(spark, f"{path}/base", finished=True) if v < version]
    before = max(older, default=-1)
    gone = [f"base/version={v}" for v in older if v < before] + [f"delta/version={v}" for v in versions(spark, f"{path}/delta") if v <= before]
    for name in gone:
        files, folder = _folder(spark, f"{path}/{name}")
        files.delete(folder, True)
