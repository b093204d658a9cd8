"""A dataset hub as a Spark data source: named datasets with configs, splits and revisions, read from a mirror.

``spark.read.format("case_hub").option("mirror", root).option("split", ...).load("owner/name")`` reads the files below
``root/owner/name/revision/config/split``: JSON lines, or Parquet. The mirror is a folder that every executor reaches; any
file system that Arrow knows will do. Files are listed once, on the driver, and read in parallel: a Parquet file by its
row groups, a file of lines by ranges of bytes, of which each gives the lines that begin in it.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslab import schemas

FORMAT = "case_hub"
DEFAULTS = {"config_name": "default", "split": "train", "revision": "main"}
RANGE_BYTES = 32_000_000
BATCH_ROWS = 1_000


@dataclass
class FilePart(InputPartition):
    """Row group ``first`` of a Parquet file, or the lines that begin in bytes ``first`` to ``end``."""

    path: str
    first: int
    end: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class CaseHub(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return schemas.CASE

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HubReader(self.options, schema)


class HubReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        missing = [k for k in ("path", "mirror") if not options.get(k)]
        if missing:
            raise ValueError(f"a hub dataset needs {' and '.join('its name' if k == 'path' else 'a mirror' for k in missing)}")
        parts = [options["path"].strip("/"), *(options.get(k) or DEFAULTS[k] for k in ("revision", "config_name", "split"))]
        self.mirror, self.folder, self.schema = options["mirror"].rstrip("/"), "/".join(parts), schema
        self.range_bytes = int(options.get("range_bytes") or RANGE_BYTES)

    def partitions(self) -> list[FilePart]:
        system, root = opened(self.mirror)
        infos = system.get_file_info(fs.FileSelector(f"{root}/{self.folder}", allow_not_found=True, recursive=True))
        files = sorted((i for i in infos if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        known = [i for i in files if i.extension in ("parquet", "jsonl", "json")]
        if not known:
            raise FileNotFoundError(f"the mirror holds no {self.folder}")
        found = []
        for info in known:
            if info.extension == "parquet":
                found += [FilePart(info.path, k, k + 1) for k in range(pq.ParquetFile(info.path, filesystem=system).num_row_groups)]
            else:
                found += [FilePart(info.path, at, min(info.size, at + self.range_bytes)) for at in range(0, info.size, self.range_bytes)]
        return found

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = opened(self.mirror)
        wanted = to_arrow_schema(self.schema)
        if part.path.endswith(".parquet"):
            table = pq.ParquetFile(part.path, filesystem=system).read_row_group(part.first)
            columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in wanted]
            yield from pa.table(columns, schema=wanted).to_batches(BATCH_ROWS)
            return
        rows = []
        for line in _lines(system, part):
            record = json.loads(line)
            rows.append({f.name: record.get(f.name) for f in wanted})
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, wanted)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, wanted)


def _lines(system: fs.FileSystem, part: FilePart) -> Iterator[bytes]:
    """The lines that begin in the part; blank ones are left out."""
    with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as file:
        if part.first:
            # The line that the byte before belongs to began in an earlier part.
            file.seek(part.first - 1)
            file.readline()
        while file.tell() < part.end:
            line = file.readline()
            if not line:
                return
            if line.strip():
                yield line


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaseHub)
