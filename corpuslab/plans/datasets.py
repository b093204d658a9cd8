"""Build a dataset folder or an export package from a source."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from corpuslab.operators import cases
from corpuslab.operators.splitting import SplitSpec
from corpuslab.sources import packages
from corpuslab.sources.resolver import SourceSpec


def build_dataset(
    spark: SparkSession, source: SourceSpec, path: str, spec: SplitSpec = SplitSpec(),
    include: Sequence[str] = (), exclude: Sequence[str] = (), mirror: str | None = None,
) -> dict[str, Any]:
    """Read, prepare, split exactly and write; returns the manifest. Hub sources are read from ``mirror``."""
    rows, label = source.load(spark, mirror=mirror)
    prepared = cases.prepare(rows, include, exclude, label=label)
    described = {name: getattr(source, name) for name in source.__dataclass_fields__}
    return packages.write_dataset(prepared, path, label, spec, include, exclude, described)


def export_dataset(
    spark: SparkSession, source: SourceSpec, path: str, spec: SplitSpec = SplitSpec(),
    include: Sequence[str] = (), exclude: Sequence[str] = (), mirror: str | None = None, **card: Any,
) -> dict[str, Any]:
    """As ``build_dataset`` for a package to publish: every row must carry a licence."""
    rows, label = source.load(spark, mirror=mirror)
    prepared = cases.prepare(rows, include, exclude, label=label, licensed=True)
    return packages.write_export(prepared, path, source.describe(), spec, include, exclude, **card)
