"""The pipeline: each stage on what the one before kept, its decisions, and its columns."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corpuslab.llm import common
from test_models import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(k, prose(rng, "aa", 40)) for k in range(8)]
    rows, gone = [], {}
    for i in range(200):
        rows.append((i, prose(rng, "aa" if i % 2 else "zz", rng.randint(80, 200)), "aa" if i % 2 else "zz", f"s{i % 3}"))
    texts = [r[1] for r in rows]
    for k, i in enumerate(range(300, 320)):
        kind, base = k % 4, texts[k]
        if kind == 0:
            text, gone[i] = base.replace(" ", "  ", 3), "exact_dedup"
        elif kind == 1:
            w = base.split()
            w[len(w) // 2] = "edited"
            text, gone[i] = " ".join(w), "near_dedup"
        elif kind == 2:
            text, gone[i] = f"{prose(rng, 'zz', 60)} {items[k % 8][1]} {prose(rng, 'zz', 60)}", "decontamination"
        else:
            text, gone[i] = ("12 34 !!", None, "")[k % 3], "language_id"
        rows.append((i, text, "zz", "s9"))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, gone


def test_each_stage_drops_what_it_should_and_nothing_else(spark, folder):
    path, gone = folder
    docs = common.table(spark, path, "documents")
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), stage(spark, docs, path).schema)
        left -= {i for i, where in gone.items() if where == name}
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == left, name
        assert docs.columns[: len(columns)] == columns
        if name != "mixing":
            assert docs.columns == columns


def test_run_gives_the_last_stage(spark, folder):
    path, gone = folder
    rows = corpus_pipeline.run(spark, path)
    assert rows.count() == 200 and rows.where("rate <= 0 or copies < 0").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]


def test_an_empty_table_passes_every_stage(spark, folder):
    docs = common.table(spark, folder[0], "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0
