from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import experiments, ordered
from corpuslab.operators import corpus


@pytest.fixture(scope="module")
def series(spark):
    """One hot key with most rows, several small ones; order values with gaps."""
    maker = random.Random(7)
    rows = []
    for key, size in [("hot", 400), ("b", 30), ("c", 3), ("d", 1)]:
        steps = sorted(maker.sample(range(-50, 5000), size))
        rows += [(key, step, round(maker.uniform(0, 3), 2)) for step in steps]
    maker.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o long, v double").repartition(6)


@pytest.mark.parametrize("width", [1, 3, 40, None])
def test_prefixes_equal_a_walk(series, width):
    rows, df = series
    found = ordered.prefixed(
        df, ["k"], "o", {"n": ("ordinal", None), "low": ("min", "v"), "low_before": ("min_before", "v"), "prev": ("previous", "v")}, width
    ).collect()
    expected = {}
    for key in {r[0] for r in rows}:
        low = prev = None
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            new = v if low is None else min(low, v)
            expected[key, o] = (n, new, low, prev)
            low, prev = new, v
    assert {(r["k"], r["o"]): (r["n"], r["low"], r["low_before"], r["prev"]) for r in found} == expected


def test_ranks_equal_a_sort(series):
    rows, df = series
    found = ordered.ranked(df, ["k"], [F.col("v").desc(), F.col("o")]).collect()
    for key in {r[0] for r in rows}:
        wanted = [o for _, o, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))]
        got = [r["o"] for r in sorted((r for r in found if r["k"] == key), key=lambda r: r["rank"])]
        assert got == wanted
        assert sorted(r["rank"] for r in found if r["k"] == key) == list(range(1, len(wanted) + 1))


@pytest.mark.parametrize("offset, limit", [(0, 0), (5, 10), (100, 0), (400, 100), (1000, 5)])
def test_slices(series, offset, limit):
    rows, df = series
    found = ordered.row_slice(df, ["k", "o"], offset, limit).collect()
    wanted = sorted(rows)[offset:]
    assert sorted(tuple(r) for r in found) == (wanted[:limit] if limit else wanted)


def walk(losses, patience, min_delta):
    best = best_step = stop = None
    stale = 0
    for step, loss in losses:
        if best is None or loss < best - min_delta:
            best, best_step, stale = loss, step, 0
        else:
            stale += 1
            if stale >= patience:
                stop = step
                break
    return best_step, best, stop


@pytest.mark.parametrize("patience, min_delta", [(1, 0.0), (3, 0.01), (5, 0.2), (50, 0.05)])
def test_early_stop_equals_a_walk(spark, patience, min_delta):
    maker = random.Random(patience)
    rows = []
    for run in range(25):
        level = 3.0
        for step in range(maker.randint(1, 80)):
            level = max(0.0, level + maker.uniform(-0.1, 0.08 if run % 2 else 0.3))
            rows.append((f"r{run}", step * 25, round(level, 3) if step % 17 != 16 else None))
    df = spark.createDataFrame(rows, "run_name string, step long, loss double").repartition(5)
    found = {r["run_name"]: (r["best_step"], r["best_loss"], r["stop_step"]) for r in experiments.early_stop(df, patience=patience, min_delta=min_delta).collect()}
    expected = {}
    for run in {r[0] for r in rows}:
        expected[run] = walk(sorted((s, l) for k, s, l in rows if k == run and l is not None), patience, min_delta)
    assert found == expected


def test_smoothed_loss_across_chunks(spark, monkeypatch):
    maker = random.Random(3)
    rows = [("a", i, maker.uniform(1, 4)) for i in range(2500)] + [("b", i * 10, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "run_name string, step long, loss double").repartition(4)
    found = {(r["run_name"], r["step"]): (r["step_no"], r["smooth_loss"]) for r in experiments.smoothed_loss(df).collect()}
    assert len(found) == len(rows)
    smooth, number = 0.0, 0
    for _, step, loss in rows[:2500]:
        smooth = 0.9 * smooth + 0.1 * loss
        assert found["a", step] == (number, pytest.approx(smooth / (1 - 0.9 ** (number + 1)), rel=1e-12))
        number += 1
    assert found["b", 40] == (4, pytest.approx(2.0))


def test_deltas_and_region(spark):
    rows = [
        ("x", 1, 1.0, "crash ", "a"), ("x", 2, 0.9, " keep", "b"), ("x", 3, None, "KEEP", "c"), ("x", 4, 0.7, "keep", "d"),
        ("x", 5, 0.9004, "discard", "e"), ("x", 6, 0.95, "discard", "f"), ("y", 1, 2.0, "discard", "g"),
    ]
    log = experiments.clean_log(spark.createDataFrame(rows, "campaign string, idx long, metric double, status string, description string"))
    deltas = {r["idx"]: r["delta"] for r in experiments.kept_deltas(log).collect()}
    assert deltas == {3: None, 4: None}
    assert [(r["idx"], r["best_so_far"]) for r in experiments.running_best(log).orderBy("idx").collect()] == [(2, 0.9), (4, 0.7)]
    assert sorted(r["idx"] for r in experiments.near_baseline(log).collect() if r["campaign"] == "x") == [2, 4, 5]
    summary = {r["campaign"]: r for r in experiments.improvement_summary(log).collect()}
    assert (summary["x"]["baseline"], summary["x"]["best"], summary["x"]["best_description"]) == (1.0, 0.7, "d")
    assert summary["y"]["best"] is None
    outcome = {r["campaign"]: r["keep_rate"] for r in experiments.outcome_counts(log).collect()}
    assert outcome == {"x": 0.6, "y": 0.0}


def test_improvement_of_zero_and_missing_metrics(spark):
    rows = [
        ("up", 1, None, "KEEP", "a"), ("up", 2, 0.0, "CRASH", "b"), ("up", 3, -2.0, "KEEP", "c"), ("down", 1, 0.0, "CRASH", "a"), ("down", 2, 3.0, "KEEP", "b"),
        ("same", 1, 0.0, "KEEP", "a"), ("none", 1, 0.0, "CRASH", "a"), ("none", 2, None, "KEEP", "b"), ("none", 3, None, "KEEP", "c"), ("some", 1, 0.7, "CRASH", "a"), ("some", 2, 0.1, "KEEP", None),
    ]
    log = spark.createDataFrame(rows, "campaign string, idx long, metric double, status string, description string")
    found = {r["campaign"]: tuple(r)[1:] for r in experiments.improvement_summary(log).collect()}
    assert found["up"] == (0.0, -2.0, "c", 2.0, float("inf")) and found["down"] == (0.0, 3.0, "b", -3.0, float("-inf"))
    assert found["same"][:4] == (0.0, 0.0, "a", 0.0) and found["same"][4] != found["same"][4]
    assert found["none"] == (0.0, None, "b", None, None) and found["some"] == (0.7, 0.1, None, 0.7 - 0.1, 100 * (0.7 - 0.1) / 0.7)


@pytest.mark.parametrize("buckets, small", [(2, 1), (3, 4), (4096, 50_000)])
@pytest.mark.parametrize("budget", [1, 57, 400, 10**9])
def test_char_budget_equals_a_walk(spark, monkeypatch, buckets, small, budget):
    maker = random.Random(budget)
    docs = [(maker.randint(-10**9, 10**12), "x" * maker.randint(0, 40)) for _ in range(60)]
    monkeypatch.setattr(corpus, "BUCKETS", buckets)
    monkeypatch.setattr(corpus, "SMALL_BUCKET", small)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in corpus.char_budget(df, "doc_id", budget=budget, cap=25).collect()}
    expected, total = {}, 0
    for doc_id, text in sorted(docs):
        expected[doc_id] = text[:25]
        total += len(text[:25])
        if total >= budget:
            break
    assert found == expected


@pytest.mark.parametrize("chunk", [3, 64, 65_536])
@pytest.mark.parametrize("beta", [0.4, 0.9, 0.999])
def test_averages_of_any_length_are_the_recurrence(spark, monkeypatch, chunk, beta):
    monkeypatch.setattr(experiments, "EMA_CHUNK", chunk)
    maker = random.Random(7)
    losses = [maker.uniform(0, 10) for _ in range(300)]
    rows = [("hot", 70_000 * i, x) for i, x in enumerate(losses)] + [("nan", 1, 1.0), ("nan", 2, float("nan")), ("nan", 3, 1.0), ("null", 1, None), ("null", 2, 2.0)]
    got = {}
    for r in experiments.smoothed_loss(spark.createDataFrame(rows, "run_name string, step long, loss double"), beta=beta).collect():
        got[r["run_name"], r["step"]] = r["smooth_loss"]
    state = 0.0
    for i, x in enumerate(losses):
        state = beta * state + (1 - beta) * x
        assert got["hot", 70_000 * i] == pytest.approx(state / (1 - beta ** (i + 1)), rel=1e-9)
    assert got["nan", 2] != got["nan", 2] and got["nan", 3] != got["nan", 3] and got["null", 1] == 0.0


def test_a_hot_key_with_sparse_order_is_cut_by_rows(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") * 70_000).alias("o"), (-F.col("id")).alias("v"))
    found = ordered.prefixed(rows, ["k"], "o", {"n": ("ordinal", None), "m": ("min", "v")}, 8)
    assert found.where("n <> o / 70000 + 1 or m <> v").count() == 0
    chunks = rows.repartitionByRange(8, "k", "o").groupBy(F.spark_partition_id()).count().collect()
    assert len(chunks) == 8 and max(r["count"] for r in chunks) < 5_000


def test_a_budget_over_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, None), (3, "abc")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus.char_budget(docs, "doc_id", 2).orderBy("doc_id").collect()] == [1, 2, 3]
    assert corpus.char_budget(docs.where("text is null"), "doc_id", 2).count() == 2


def test_a_top_of_tied_rows_does_not_hang_on_their_order(spark):
    rows = [("k", n, "_" * (n % 3)) for n in range(200)]
    slices = []
    for parts, given in ((1, rows), (7, rows[::-1])):
        df = spark.createDataFrame(given, "k string, n long, _content string").repartition(parts)
        slices.append([{tuple(r) for r in ordered.row_slice(df, ["k"], at, 50).collect()} for at in (0, 50, 100, 150)])
    assert slices[0] == slices[1] and set().union(*slices[0]) == set(rows)


@pytest.mark.parametrize("top", [0, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_slices_of_tied_and_null_keys_are_pages(spark, monkeypatch, descending, top):
    monkeypatch.setattr(ordered, "TOP_ROWS", top)
    maker = random.Random(3)
    values = [None] * 7 + ["hot"] * 60 + [maker.choice("abcxyz") for _ in range(60)]
    rows = [(v, maker.choice([None, 1.5, 2.5]), k // 2) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(5)
    order = [ordered.Key("k", descending), ordered.Key("v")]
    rank = lambda r: (((r[0] is None) != descending, "" if r[0] is None else r[0]), (r[1] is not None, r[1] or 0))
    wanted = sorted(rows, key=lambda r: rank(r)[1])
    wanted.sort(key=lambda r: (r[0] is not None, r[0] or ""), reverse=descending)
    pages = []
    for offset in range(0, len(rows), 45):
        page = [tuple(r) for r in ordered.row_slice(df, order, offset, 45).collect()]
        assert [r[:2] for r in page] == [r[:2] for r in wanted[offset : offset + 45]]
        pages += page
    assert sorted(pages, key=repr) == sorted(rows, key=repr)
    rest = [tuple(r) for r in ordered.row_slice(df, order, 100).collect()]
    assert sorted(rest, key=repr) == sorted(pages[100:] if len(pages) > 100 else [], key=repr) or len(rest) == len(rows) - 100


def test_a_slice_filters_in_the_scan_and_checkpoints_keys_alone(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(3000).selectExpr("id AS k", "repeat('x', 100) AS wide").write.parquet(path)
    plan = ordered.row_slice(spark.read.parquet(path), ["k"], 1000, 50)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,1000)" in text.replace("999", "1000") and "LessThanOrEqual(k,1049)" in text and "ExistingRDD" not in text
    assert [r["k"] for r in plan.collect()] == list(range(1000, 1050))


@pytest.mark.parametrize("beta", [0.0, 0.4, 0.9, 0.9999])
def test_averages_keep_odd_losses_and_their_columns(spark, monkeypatch, beta):
    monkeypatch.setattr(experiments, "EMA_CHUNK", 16)
    losses = [1e12, 5.0, None, 2.0, *[float(i % 7) for i in range(100)], float("inf"), 1.0, float("-inf"), 3.0]
    rows = [(None, i * 3, x, "kept") for i, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "run_name string, step long, loss double, no string")
    got = sorted((r["step_no"], r["smooth_loss"], r["no"], r["loss"]) for r in experiments.smoothed_loss(df, beta=beta).drop("run_name").collect() if r["loss"] is not None)
    state, at = 0.0, 0
    for i, x in enumerate(losses):
        if beta == 0 and i > len(losses) - 5:
            break  # 0 times infinity
        state = beta * state + (1 - beta) * (x or 0.0)
        if x is None:
            continue
        want = state / (1 - beta ** (i + 1))
        assert got[at][0] == i and got[at][2] == "kept" and (got[at][1] == pytest.approx(want, rel=1e-9) or (want != want and got[at][1] != got[at][1])), i
        at += 1


def test_a_falling_run_is_followed_by_pointers_over_many_tasks(spark):
    n = 20_000
    falling = spark.range(n).selectExpr("'hot' AS run_name", "id * 3 AS step", "CAST((%d - id) * 0.004 AS DOUBLE) AS loss" % n)
    more = spark.createDataFrame([(None, 1, 2.0), (None, 2, 1.0), (None, 3, 1.0), ("one", 5, 0.5)], "run_name string, step long, loss double")
    rows = falling.unionByName(more).repartition(6)
    found = {r["run_name"]: r for r in experiments.early_stop(rows, patience=3, min_delta=0.01).collect()}
    want = walk([(3 * i, (n - i) * 0.004) for i in range(n)], 3, 0.01)
    assert (found["hot"]["best_step"], found["hot"]["best_loss"], found["hot"]["stop_step"]) == pytest.approx(want)
    assert (found[None]["best_step"], found[None]["n_evals"], found["one"]["best_loss"]) == (2, 3, 0.5)
    stopped = {r["run_name"]: r for r in experiments.early_stop(rows, patience=2, min_delta=0.01).collect()}["hot"]
    assert (stopped["best_step"], stopped["stop_step"]) == walk([(3 * i, (n - i) * 0.004) for i in range(n)], 2, 0.01)[::2]
    plan = experiments.early_stop(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
