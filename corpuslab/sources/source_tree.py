"""Python files of checked-out repositories as a table.

Spark's own file sources hold the listing of every file on the driver. A checkout of many small files is mostly listing,
so folders are listed here in tasks, one level after the other, and only the number of folders comes back.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.operators import keys
from corpuslab.session import checkpointed
from corpuslab.sources import hub

REQUIRED = ("name", "repo_url", "license", "domain", "include_paths")
# A task lists so many folders, and reads so many files or bytes, on average.
TASK_FOLDERS = 16
TASK_FILES = 5_000
TASK_BYTES = 64_000_000
BATCH_BYTES = 8_000_000


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Repository manifest; a missing field raises, a missing revision means the head."""
    from corpuslab.sources.records import read_cases

    rows = read_cases(spark, path, schemas.REPO_MANIFEST)
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    keys.require_empty(rows.select(missing.alias("missing")).filter("missing != ''"), "Repo manifest entry missing keys")
    return rows.withColumn("ref", F.coalesce("ref", F.lit("HEAD")))


def _listed(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    """``(path, size)`` of the ``*.py`` files below folders of ``root``; a folder that is not there has none."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = hub.opened(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = f"{base}/{folder}".rstrip("/") or "/"
                if system.get_file_info(at).type != fs.FileType.Directory:
                    continue
                infos = [i for i in system.get_file_info(fs.FileSelector(at)) if not i.is_file or i.base_name.endswith(".py")]
                paths = [i.path[len(base) :].lstrip("/") for i in infos]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([i.size for i in infos], pa.int64())], ["path", "size"])

    level = spark.createDataFrame([(folder,) for folder in folders], "path string").repartition(max(1, len(folders)))
    found = spark.createDataFrame([], "path string, size long")
    while True:
        # Only files have a size.
        below = checkpointed(level.mapInArrow(entries, "path string, size long"))
        found = found.unionByName(below.filter(F.col("size").isNotNull()))
        level = below.filter(F.col("size").isNull()).select("path")
        if not (count := level.count()):
            return found
        level = level.repartition(-(-count // TASK_FOLDERS))


def _outermost(folders: Sequence[str]) -> list[str]:
    """Folders below the root in their plain form, without those that lie in another one."""
    plain = {posixpath.normpath(f.strip("/") or ".") for f in folders}
    inside = sorted("" if f == "." else f for f in plain if f.split("/")[0] != "..")
    return [f for f in inside if not any(g != f and f.startswith(g and g + "/") for g in inside)]


def read_sources(spark: SparkSession, root: str, folders: Sequence[str] = (".",)) -> DataFrame:
    """``(path, code)`` of the ``*.py`` files below folders of ``root``, tests and package markers left out.

    One row per file, read once, wherever the folders overlap. The text is kept to the last character, with line ends as
    Python reads them.
    """
    listed = _listed(spark, root, _outermost(folders))
    name = F.substring_index("path", "/", -1)
    files = listed.filter(~F.startswith(name, F.lit("test_")) & (name != "__init__.py"))
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = hub.opened(root)
        batch_of = lambda rows: pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["path", "content"]
        )
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base.rstrip('/')}/{path}") as file:
                    rows.append((path, file.read()))
                held += len(rows[-1][1])
                if held >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    parts = max(spark.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)
    contents = files.select("path").repartition(parts).mapInArrow(read, "path string, content binary")
    return contents.select("path", F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("code"))


def read_repository(spark: SparkSession, checkout: str, entry: Mapping[str, object]) -> DataFrame:
    """Files under the entry's include paths, with the repository's own columns; a path that is not there gives none."""
    include: Sequence[str] = entry["include_paths"]  # type: ignore[assignment]
    rows = read_sources(spark, checkout, include)
    return rows.select(
        *[F.lit(entry[c]).alias(c) for c in ("name", "repo_url", "license", "domain")],
        F.lit(entry.get("ref") or "HEAD").alias("ref"), "path", "code",
    )
