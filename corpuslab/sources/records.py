"""Case files: JSON lines or one JSON array, with an explicit schema.

Fields that the schema does not know are kept on request: ``read_open_cases`` reads every record once, as a variant, and
gives the known fields with their types and all others in a map of variants, REST, which travels through joins and
unions like any column and is merged into the records again where they are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab import schemas

REST = "_rest"
# Partition column of tables that batches are appended to.
BATCH = "batch_id"
# Type names as the audit reports them, by variant type (fixed values).
_TYPE_NAMES = {
    "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "float", "VOID": "NoneType",
}
# Type each audited field must have (fixed values).
_EXPECTED = {
    "case_id": "str", "prompt": "str", "completion": "str", "entry_scene": "str",
    "tags": "list", "must_contain": "list", "must_not_contain": "list",
}


def read_cases(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = schemas.CASE) -> DataFrame:
    """``.jsonl`` (or a folder of them) is read a line per record, ``.json`` as arrays; a malformed record raises."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    arrays = [p for p in paths if p.endswith(".json")]
    lines = [p for p in paths if not p.endswith(".json")]
    if arrays and lines:
        return reader.json(lines).unionByName(reader.option("multiLine", True).json(arrays))
    return reader.option("multiLine", True).json(arrays) if arrays else reader.json(lines)


def _variants(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Each record of the files as one variant, ``record``; a malformed one raises."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.format("json").option("singleVariantColumn", "record").option("mode", "FAILFAST")
    arrays, lines = [p for p in paths if p.endswith(".json")], [p for p in paths if not p.endswith(".json")]
    found = [reader.load(lines)] if lines else []
    if arrays:
        whole = reader.option("multiLine", True).load(arrays)
        found.append(whole.select(F.explode(F.col("record").cast("array<variant>")).alias("record")))
    return found[0] if len(found) == 1 else found[0].select("record").unionByName(found[1])


def read_open_cases(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = schemas.CASE) -> DataFrame:
    """As ``read_cases``, with what a record holds beyond the schema in ``REST`` (null where that is nothing)."""
    record = F.col("record")
    others = F.map_filter(record.cast("map<string,variant>"), lambda name, _: ~name.isin(*schema.names))
    known = [F.variant_get(record, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    return _variants(spark, path).select(*known, F.when(F.size(others) > 0, others).alias(REST))


def _merged(df: DataFrame, but: Sequence[str]) -> Column:
    """A row as one JSON object: its columns, nulls included, then what REST holds beyond them."""
    own = [c for c in df.columns if c != REST and c not in but]
    known = F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]), {"ignoreNullFields": "false"})
    others = F.map_filter(F.col(REST), lambda name, _: ~name.isin(*own))
    more = F.substring(F.to_json(others, {"ignoreNullFields": "false"}), 2, 2**31 - 1)
    return F.when(F.size(others) > 0, F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.lit(","), more)).otherwise(known)


def write_records(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", **options: str) -> None:
    """JSON lines, one file per task. ``path`` must be a new version, never one the frame reads from.

    A column REST is not written as such: its fields are merged into their records. ``options`` are the writer's, as ``compression``.
    """
    if REST in df.columns:
        writer = df.select(_merged(df, partition_by).alias("value"), *partition_by).write.mode(mode).options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).text(path)
        return
    writer = df.write.mode(mode).option("ignoreNullFields", False).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def append_once(df: DataFrame, path: str, batch: str) -> None:
    """Append the rows as the batch of that name: a batch that is written again replaces its own rows and no others."""
    rows = df.withColumn(BATCH, F.lit(batch))
    if REST in df.columns:
        rows = rows.select(_merged(df, ()).alias("value"), BATCH)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH)
    writer.text(path) if REST in df.columns else writer.option("ignoreNullFields", False).json(path)


def appended_ids(spark: SparkSession, path: str, but: str | None = None) -> DataFrame | None:
    """The ``case_id`` of what was appended below a path, batch ``but`` left out; None where nothing was written yet.

    Files of no batch, as plain appends leave them, count as well.
    """
    try:
        rows = spark.read.schema("case_id string").option("recursiveFileLookup", True).json(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if but is None:
        return rows
    own = F.contains(F.col("_metadata.file_path"), F.lit(f"/{BATCH}={but}/"))
    return rows.filter(~own).select("case_id")


def type_violations(spark: SparkSession, path: str) -> DataFrame:
    """``(case_id, field, detail)`` for each record field of the wrong type or missing.

    Records are read as variants, so nothing is coerced before it is looked at.
    """
    raw = spark.read.format("json").option("singleVariantColumn", "record").load(path)
    record = F.col("record")

    def type_name(field: str):
        kind = F.schema_of_variant(F.try_variant_get(record, f"$.{field}", "variant"))
        named = F.when(F.startswith(kind, F.lit("ARRAY")), "list").when(F.startswith(kind, F.lit("OBJECT")), "dict")
        for variant, name in _TYPE_NAMES.items():
            named = named.when(kind == variant, name)
        return named.when(F.startswith(kind, F.lit("DECIMAL")), "float")

    checks = [
        F.when(type_name(field).isNull(), F.struct(F.lit(field).alias("field"), F.lit("missing").alias("detail"))).when(
            type_name(field) != expected,
            F.struct(
                F.lit(field).alias("field"),
                F.concat(F.lit(f"must be {expected}, got "), type_name(field)).alias("detail"),
            ),
        )
        for field, expected in _EXPECTED.items()
    ]
    return raw.select(
        F.try_variant_get(record, "$.case_id", "string").alias("case_id"), F.explode(F.array_compact(F.array(*checks))).alias("v")
    ).select("case_id", "v.field", "v.detail")
