from __future__ import annotations

import json
import random

import pytest

from corpuslab import schemas
from corpuslab.operators import curation, evaluation, experiments, keys, review
from corpuslab.plans import curation as curation_plans
from corpuslab.streaming import early_stop, ratings, run_summaries, snapshots, state


def sides(spark, *rows):
    return spark.createDataFrame(list(rows), "case_id string, scene_name string, syntax_ok boolean, render_ok boolean, weighted_score double, prompt string")


COLUMNS = ("scene_name", "syntax_ok", "render_ok", "weighted_score", "prompt")


def test_session_and_ratings(spark):
    left = sides(spark, *[(f"c{i}", "L", True, i != 3, 0.5, "" if i == 1 else f"left {i}") for i in range(8)], ("only left", "L", True, True, 0.1, "p"))
    right = sides(spark, *[(f"c{i}", "R", True, True if i != 4 else None, 0.7, f"right {i}") for i in range(8)])
    pairs = review.prompt_backfill(review.paired_runs(left, right, COLUMNS))
    session = review.blind_session(pairs, "one", "two", seed=7).persist()
    assert sorted(r["case_id"] for r in review.session_skipped(session).collect()) == ["c3", "c4"]
    items = review.session_items(session)
    rows = {r["case_id"]: r for r in items.collect()}
    assert len(rows) == 6 and rows["c1"]["prompt"] == "right 1" and rows["c0"]["prompt"] == "left 0"
    # the same item gets the same order, and swapping the sides swaps the slots' labels
    swapped = review.blind_session(review.prompt_backfill(review.paired_runs(right, left, COLUMNS)), "two", "one", seed=7)
    for r in review.session_items(swapped).collect():
        assert {o["slot"] for o in r["options"]} == {"A", "B"}
        assert r["options"][0]["source_side"] == rows[r["case_id"]]["options"][0]["source_side"]
        assert r["options"][0]["label"] != rows[r["case_id"]]["options"][0]["label"]
    given = spark.createDataFrame([("c0", "A", "high", " good "), ("c1", "both_bad", None, None)], "review_id string, verdict string, confidence string, notes string")
    found = {r["review_id"]: r for r in review.rating_records(items, given).collect()}
    assert found["c0"]["preferred_label"] == rows["c0"]["options"][0]["label"] and found["c0"]["notes"] == "good"
    assert found["c1"]["preferred_label"] is None and found["c1"]["preferred_slot"] is None
    assert tuple(review.session_progress(items, given).first()) == (6, 2, 4)
    shown = {r["review_id"]: r for r in review.public_items(items, given).collect()}
    assert shown["c0"]["rated"] and not shown["c2"]["rated"] and set(shown["c0"]["options"][0].asDict()) == {"slot", "render_ok", "scene_name"}
    everything = review.session_items(review.blind_session(pairs, "one", "two", include_failed=True))
    assert everything.count() == 8
    session.unpersist()


def test_labels_fall_back_to_stems():
    assert review.resolved_labels(None, None, "a", "b", "x", "y") == ("a", "b")
    assert review.resolved_labels(None, None, "a", "a", "x", "y") == ("x", "y")
    assert review.resolved_labels("L", None, None, "L", "x", "y") == ("L", "y")


def test_progress_never_negative(spark):
    items = spark.createDataFrame([("a",)], "review_id string")
    rated = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "review_id string")
    assert tuple(review.session_progress(items, rated).first()) == (1, 3, 0)


def dataset(spark, *ids):
    names = schemas.CASE.names
    return spark.createDataFrame([tuple({"case_id": i, "tags": ["tier:candidate"]}.get(n) for n in names) for i in ids], schemas.CASE)


def decisions(spark, **choices):
    return spark.createDataFrame(list(choices.items()), "case_id string, decision string")


def test_apply_decisions(spark):
    applied = curation.apply_decisions(dataset(spark, "a", "b", "c"), decisions(spark, a="reject", b="promote", c="Reject"))
    assert sorted(r["case_id"] for r in applied.dataset.collect()) == ["b", "c"]
    assert [r["case_id"] for r in applied.archived.collect()] == ["a"]
    assert {(r["case_id"], r["decision"], r["notes"]) for r in applied.log_entries.collect()} == {("a", "reject", ""), ("b", "promote", "")}
    log = spark.createDataFrame([("b",)], "case_id string")
    for message, ratings_given, extra in (
        ("No promote/reject", {"a": "skip"}, {}), ("unknown dataset case_ids: z", {"z": "reject"}, {}),
        ("already applied.*: b", {"b": "promote"}, {"log": log}), ("already archived: b", {"b": "reject"}, {"archive": log}),
    ):
        with pytest.raises(keys.CheckFailed, match=message):
            curation.apply_decisions(dataset(spark, "a", "b"), decisions(spark, **ratings_given), **extra)


def test_apply_review_writes_versions(spark, tmp_path):
    from corpuslab.sources import records

    records.write_records(dataset(spark, "a", "b", "c"), str(tmp_path / "v1"))
    summary = curation_plans.apply_review(
        spark, str(tmp_path / "v1"), decisions(spark, a="reject", b="promote"), str(tmp_path / "v2"), str(tmp_path / "log"), str(tmp_path / "archive"), "r1"
    )
    assert (summary["num_promoted"], summary["num_rejected"], summary["num_remaining_dataset_cases"]) == (1, 1, 2)
    assert records.read_cases(spark, str(tmp_path / "v2")).count() == 2 and records.read_cases(spark, str(tmp_path / "v1")).count() == 3
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and records.read_cases(spark, str(tmp_path / "archive")).count() == 1
    again = curation_plans.promote_candidates(
        spark, str(tmp_path / "v2"), decisions(spark, b=" Winner "), str(tmp_path / "promoted"), str(tmp_path / "rest")
    )
    assert again == {"num_promoted": 1, "num_remaining_candidates": 1}
    promoted = records.read_cases(spark, str(tmp_path / "promoted")).first()
    assert promoted["tags"] == ["tier:silver", "status:approved", "source:review-promotion"] and promoted["license"] == "MIT"


def test_approvals(spark):
    rows = spark.createDataFrame([("a", "", "KEEP "), ("b", "no", "keep"), ("c", None, None), ("d", "promote", None), ("d", "good", None)], "case_id string, decision string, label string")
    assert sorted(r["case_id"] for r in curation.approved_ids(rows).collect()) == ["a", "d"]


def test_review_batch(spark):
    cases = dataset(spark, *[f"c{i}" for i in range(9)])
    rated = [spark.createDataFrame([("c1",), ("",)], "case_id string"), spark.createDataFrame([("c3",), (None,)], "case_id string")]
    assert [r["case_id"] for r in review.review_batch(cases, rated, 1, 3).collect()] == ["c2", "c4", "c5"]
    assert review.review_batch(cases, rated).count() == 7 and review.review_batch(cases, [], 2).count() == 7


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_ratings_stream(spark, tmp_path):
    schema = "review_id string, verdict string, notes string, arrival long"
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "review_id string")
    def start():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        ratings.start(arriving, items, str(tmp_path / "out"), "arrival", once=True).awaitTermination()

    write_lines(tmp_path / "in", "1.json", [
        {"review_id": "i1", "verdict": "nope", "arrival": 1}, {"review_id": "i1", "verdict": "B", "arrival": 3},
        {"review_id": "i1", "verdict": "A", "arrival": 2}, {"review_id": "zz", "verdict": "A", "arrival": 4}, {"verdict": "A", "arrival": 5},
    ])
    start()
    write_lines(tmp_path / "in", "2.json", [
        {"review_id": "i1", "verdict": "B", "arrival": 6}, {"review_id": "i2", "verdict": "both_good", "arrival": 7}, {"review_id": "i3", "verdict": "promote", "arrival": 8},
    ])
    start()
    start()
    accepted = {(r["review_id"], r["verdict"], r["arrival"]) for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()}
    refused = {(r["arrival"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out/refused")).collect()}
    assert accepted == {("i1", "A", 2), ("i2", "both_good", 7)}
    assert refused == {(1, ratings.INVALID), (3, ratings.REPEATED), (4, ratings.UNKNOWN), (5, ratings.MISSING_ID), (6, ratings.REPEATED), (8, ratings.INVALID)}


def test_rating_kinds():
    assert ratings.answers("sample_review")[0] == "decision" and "both_good" in ratings.answers("blind_pair")[1]


def test_run_summaries_stream(spark, tmp_path):
    schema = "run_name string, syntax_ok boolean, render_ok boolean, weighted_score double"
    def start():
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        run_summaries.start(arriving, str(tmp_path / "out"), once=True).awaitTermination()

    def rows(n, run):
        return [{"run_name": run, "syntax_ok": i % 3 != 0, "render_ok": None if i % 3 == 0 else i % 2 == 0, "weighted_score": i / 16} for i in range(n)]

    write_lines(tmp_path / "in", "1.json", rows(4, "a") + rows(2, "b"))
    start()
    write_lines(tmp_path / "in", "2.json", rows(8, "a"))
    write_lines(tmp_path / "in", "3.json", rows(3, "c"))
    start()
    live = sorted(tuple(r) for r in run_summaries.latest(spark, str(tmp_path / "out")).collect())
    batch = sorted(tuple(r) for r in evaluation.run_summary(spark.read.schema(schema).json(str(tmp_path / "in"))).collect())
    assert live == batch and len(live) == 3


def test_early_stop_stream_carries_state(spark, tmp_path):
    schema = "run_name string, step long, loss double"
    losses = {"a": [3, 2, 2, 2.5, 1, 1, 1, 1, 0.1], "b": [1, 2, 0.5, 0.6], "c": [5, 4, 3, 2, 1]}
    for part in range(3):
        rows = [{"run_name": k, "step": i, "loss": float(v)} for k, vs in losses.items() for i, v in enumerate(vs) if i // 3 == part]
        write_lines(tmp_path / "in", f"{part}.json", rows)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        early_stop.start(arriving, str(tmp_path / "out"), once=True).awaitTermination()
    live = {r["run_name"]: (r["best_step"], r["best_loss"], r["stop_step"], r["stopped"]) for r in early_stop.latest(spark, str(tmp_path / "out")).collect()}
    batch = experiments.early_stop(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()
    assert live == {r["run_name"]: (r["best_step"], r["best_loss"], r["stop_step"], r["stopped"]) for r in batch}
    assert live["a"] == (4, 1.0, 7, True) and live["c"] == (4, 1.0, None, False)


def test_all_rendered_and_leaderboard(spark):
    rows = spark.createDataFrame(
        [("m1", "x", True, True, 0.5), ("m2", "x", True, True, 0.6), ("m1", "y", True, True, 0.1), ("m2", "y", None, True, 0.2), ("m1", "z", True, True, 0.3)],
        "run_name string, case_id string, render_ok boolean, syntax_ok boolean, weighted_score double",
    )
    found = {r["case_id"]: (r["complete"], [o["name"] for o in r["rows"]]) for r in evaluation.all_rendered(rows, ["m2", "m1"]).collect()}
    assert found == {"x": (True, ["m2", "m1"]), "y": (False, ["m2", "m1"]), "z": (False, ["m1"])}
    summary = spark.createDataFrame([("a", 0.7, None, 0.9, None), ("b", 0.7, 0.1, 0.1, None), ("c", None, 0.9, 0.9, None), ("d", 0.9, 1.0, 1.0, "boom")],
                                    "run_name string, mean_case_score double, render_success_rate double, syntax_success_rate double, error string")
    assert [r["run_name"] for r in evaluation.leaderboard(summary, error="error").orderBy("rank").collect()] == ["b", "a", "c"]
    assert evaluation.run_summary(rows).filter("run_name = 'm2'").first()["render_success_rate"] == 1.0


def test_one_of_several_ratings_with_equal_arrival_wins(spark):
    rows = [("i1", "A", 5), ("i1", "B", 5), ("i1", "B", 5), ("i2", "nope", 1), ("i2", "A", 2), (None, "A", 1), ("i9", "A", 1)]
    batch = spark.createDataFrame(rows, "review_id string, verdict string, arrival long").repartition(3)
    items = spark.createDataFrame([("i1",), ("i2",)], "review_id string")
    accepted, refused = ratings.route(batch, items, batch.limit(0), "arrival")
    assert sorted(r["review_id"] for r in accepted.collect()) == ["i1", "i2"] and refused.count() == 5
    winners = {accepted.where("review_id = 'i1'").first()["verdict"] for accepted, _ in [ratings.route(batch.repartition(n), items, batch.limit(0), "arrival") for n in (1, 4)]}
    assert len(winners) == 1


def test_snapshots_stay_bounded_over_many_micro_batches(spark, tmp_path):
    path, newest = str(tmp_path / "s"), {}
    schema = spark.createDataFrame([], "k string, x double, n long").schema
    for version in range(50):
        rows = [(f"k{version % 7}", version / 2, version), ("each", 1.0, version)]
        newest |= {r[0]: r for r in rows}
        snapshots.publish(spark.createDataFrame(rows, schema), version, path, "k", every=8)
        if version in (7, 8, 30, 49):
            assert {tuple(r) for r in snapshots.latest(spark, path, "k", schema).collect()} == set(newest.values())
    assert snapshots.versions(spark, f"{path}/base") == [39, 47] and snapshots.versions(spark, f"{path}/delta") == list(range(40, 50))
    # The last fold runs again after a failure, with what it needs still there.
    snapshots.publish(spark.createDataFrame([("k5", 23.5, 47), ("each", 1.0, 47)], schema), 47, path, "k", every=8)
    assert {tuple(r) for r in snapshots.latest(spark, path, "k", schema).collect()} == set(newest.values())
    # A base whose writer has not committed is not read.
    (tmp_path / "s/base/version=90").mkdir()
    assert snapshots.latest(spark, path, "k", schema).count() == len(newest)
    assert snapshots.latest(spark, str(tmp_path / "none"), "k", schema).count() == 0


def arrive(spark, tmp_path, schema, batches, begin):
    for part, rows in enumerate(batches):
        write_lines(tmp_path / "in", f"{part}.json", rows)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        begin(arriving).awaitTermination()


def test_early_stop_stream_orders_steps_across_micro_batches(spark, tmp_path):
    maker, rows = random.Random(4), []
    for run in ("a", "b", "c", None):
        level = 3.0
        for step in range(60):
            level = max(0.0, level + maker.uniform(-0.15, 0.1))
            rows.append({"run_name": run, "step": step, "loss": round(level, 3) if step % 13 else None})
    rows.sort(key=lambda r: r["step"] + maker.uniform(0, 12))
    batches = [rows[k : k + 48] for k in range(0, len(rows), 48)]
    schema, path = "run_name string, step long, loss double", str(tmp_path / "out")
    arrive(spark, tmp_path, schema, batches, lambda s: early_stop.start(s, path, once=True, every=2, slack=12, patience=8))
    live = {r["run_name"]: tuple(r)[1:] for r in early_stop.progress(spark, path).collect()}
    batch = experiments.early_stop(spark.createDataFrame([tuple(r.values()) for r in rows], schema), patience=8).collect()
    assert live == {r["run_name"]: (r["best_step"], r["best_loss"], r["stop_step"], r["stopped"], 0) for r in batch}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != state.ROCKSDB


class Held:
    """State variables in memory, for a processor without a stream."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):
        return HeldValue(self.values, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class HeldValue:
    def __init__(self, values, name):
        self.values, self.name = values, name

    def exists(self):
        return self.name in self.values

    def get(self):
        return self.values[self.name]

    def update(self, value):
        self.values[self.name] = value

    put = update

    def clear(self):
        del self.values[self.name]


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_waiting_steps_are_bounded_late_ones_counted_and_timers_take_the_rest():
    held, walk = Held(), early_stop.Walk(patience=3, min_delta=0.0, slack=1000, most=5, idle=50)
    walk.init(held)
    give = lambda steps: next(walk.handleInputRows(("r",), iter([{"step": s, "loss": 100.0 - s} for s in steps]), Clock()))
    row = give(range(20))
    assert len(held.values["pending"]) == 5 and row["best_step"] == 19 and held.timers == {1050}
    row = give([3, 14, 16, 16])
    assert row["n_late"] == 2 and len(held.values["pending"]) == 5 and row["best_step"] == 19
    give(range(20, 3000))
    assert len(held.values["pending"]) == 5
    row = next(walk.handleExpiredTimer(("r",), Clock(), None))
    assert "pending" not in held.values and row["best_step"] == 2999 and not row["stopped"]
    row = next(walk.handleInputRows(("r",), iter([{"step": 3000 + k, "loss": 9e9} for k in range(2000)]), Clock()))
    assert row["stop_step"] == 3002 and row["stopped"]


def test_ratings_stream_remembers_ids_and_breaks_ties(spark, tmp_path):
    schema, path = "review_id string, decision string, arrival long, more array<long>", str(tmp_path / "out")
    items = spark.createDataFrame([(f"i{k}",) for k in range(5)], "review_id string")
    maker = random.Random(9)
    batches = [
        [{"review_id": maker.choice([None, "i0", "i1", "i2", "i3", "zz"]), "decision": maker.choice(["promote", "reject", "?", None]), "arrival": maker.choice([None, 1, 2, 3]), "more": [2**60 + k]} for k in range(25)]
        for _ in range(4)
    ]
    arrive(spark, tmp_path, schema, batches, lambda s: ratings.start(s, items, path, "arrival", "sample_review", once=True))
    kind = spark.createDataFrame([], schema).schema
    accepted, refused, earlier = [], [], spark.createDataFrame([], kind)
    for rows in batches:
        batch = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
        good, bad = ratings.route(batch, items, earlier, "arrival", "sample_review")
        accepted, refused = accepted + good.collect(), refused + bad.collect()
        earlier = spark.createDataFrame([tuple(r) for r in accepted], kind)
    columns = kind.names
    assert sorted(map(repr, spark.read.parquet(f"{path}/accepted").select(columns).collect())) == sorted(map(repr, accepted))
    assert sorted(map(repr, spark.read.parquet(f"{path}/refused").select(*columns, "reason").collect())) == sorted(map(repr, refused))
    ids = [r["review_id"] for r in accepted]
    assert len(set(ids)) == len(ids) >= 3


def test_listed_examples_are_all_returned(spark):
    rows = spark.createDataFrame(
        [("m1", "x", True, True, 0.5, ""), ("m2", "x", True, True, 0.6, "say"), ("m1", "y", True, True, 0.1, "p"), ("m2", "y", None, True, 0.2, "q")],
        "run_name string, case_id string, render_ok boolean, syntax_ok boolean, weighted_score double, prompt string",
    )
    spec = spark.createDataFrame([("x", "X", "s", ["m2", "m1"]), ("y", "Y", "s", ["m1", "m2", "m3"]), ("gone", "G", "s", ["m1"]), ("bare", "B", "s", [])], "case_id string, title string, summary string, models array<string>")
    found = {r["case_id"]: r for r in evaluation.rendered_examples(rows, spec, strict=False).collect()}
    assert found["x"]["prompt"] == "say" and [r["name"] for r in found["x"]["rows"]] == ["m2", "m1"] and found["x"]["problems"] == []
    assert found["y"]["problems"] == ["m2: not rendered", "m3: no result"] and found["gone"]["problems"] == ["m1: no result"]
    assert found["bare"]["problems"] == ["no models"] and found["gone"]["prompt"] == ""
    with pytest.raises(keys.CheckFailed, match="all-rendered examples: bare, gone, y"):
        evaluation.rendered_examples(rows, spec)
    assert evaluation.rendered_examples(rows, spec.where("case_id = 'x'")).count() == 1


def test_streams_deal_a_turn_to_many_files(spark):
    from pyspark.sql import functions as F

    from checks import stream_queries

    table = spark.range(0, 4000, 1, 5).withColumn("x", F.col("id") * 2)
    arriving = stream_queries.stream(spark, table, stream_queries.quarters(F.col("id"), 3999))
    seen = []
    query = arriving.writeStream.foreachBatch(lambda rows, _: seen.append(
        [(r["n"], r["low"], r["high"]) for r in rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()]
    )).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == stream_queries.BATCHES
    for k, files in enumerate(seen):
        assert len(files) == 5 and all(150 <= n <= 250 for n, _, _ in files)
        assert (min(low for _, low, _ in files), max(high for _, _, high in files)) == (1000 * k, 1000 * k + 999)
