"""Every query against its SQL on the smallest tables, and facts about some plans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks import views
from checks.compare import check, oracle
from corpuslab.operators import canonical, cases, corpus, evaluation, experiments, keys, splitting


@pytest.fixture(scope="module")
def connection(tables):
    return oracle(tables)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, tables, connection, name):
    assert check(spark, tables, name, connection) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.count() > 0 and rows.columns == ["split", "lang", "duration", "n_cases"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_adds_no_shuffle(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select(F.col("doc_id").cast("string").alias("case_id"), "text")
    assert "Exchange" not in plan(splitting.exact_split(rows))


def test_budget_is_a_pushed_filter(spark, tables):
    taken = corpus.char_budget(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text"), "doc_id", budget=50_000)
    assert "Exchange" not in plan(taken) and "LessThanOrEqual(doc_id" in plan(taken)


def test_native_operators_start_no_python(spark, tables):
    rows = views.cases(spark, tables)
    for df in (cases.chat_records(cases.normalise(rows)), canonical.rebuild([(rows, ["t"])], strict=False), views.summary(spark, tables)):
        assert not any(node in plan(df) for node in ("EvalPython", "MapInPandas", "MapInArrow"))


def test_hot_keys_do_not_gather(spark, tables):
    """No window over a whole campaign and no exchange to one partition."""
    log = experiments.clean_log(views.experiments(spark, tables))
    for df in (experiments.running_best(log), experiments.kept_deltas(log), experiments.near_baseline(log)):
        assert "SinglePartition" not in plan(df)
        windows = [line for line in plan(df).splitlines() if "windowspecdefinition(campaign" in line and "_chunk" not in line]
        assert windows == []


def test_narrow_checks(spark, tables):
    """Key checks read the key columns alone."""
    found = plan(keys.duplicate_keys(views.cases(spark, tables), "case_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in found


def test_grid_plans_no_join(spark, tables):
    grid = evaluation.evaluation_grid(views.holdout(spark, tables), [{"name": "a"}, {"name": "b"}], ["name"])
    assert "Join" not in plan(grid) and grid.count() == 2 * views.holdout(spark, tables).count()
