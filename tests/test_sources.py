from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from checks import source_queries
from corpuslab import schemas
from corpuslab.operators import evaluation
from corpuslab.operators.splitting import SplitSpec
from corpuslab.plans import curation as curation_plans
from corpuslab.plans import datasets
from corpuslab.plans import evaluation as evaluation_plans
from corpuslab.sources import hub, logs, packages, payloads, records, shards, source_tree
from corpuslab.sources.resolver import SourceSpec

CASES = [{"case_id": f"c{i}", "prompt": f"p{i}", "completion": "x", "license": "MIT", "tags": ["even"] if i % 2 == 0 else ["odd"], "extra": i} for i in range(12)]


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(c) for c in CASES[:6]) + "\n\n")
    (tmp_path / "array.json").write_text(json.dumps(CASES[6:], indent=2))
    return tmp_path


def test_read_both_formats(spark, files):
    rows = records.read_cases(spark, [str(files / "lines.jsonl"), str(files / "array.json")])
    assert sorted(r["case_id"] for r in rows.collect()) == sorted(c["case_id"] for c in CASES)
    assert rows.schema == schemas.CASE or rows.columns == schemas.CASE.names
    (files / "bad.jsonl").write_text('{"case_id": "a"}\n{"case_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.read_cases(spark, str(files / "bad.jsonl")).collect()


def test_type_violations(spark, tmp_path):
    good = {"case_id": "a", "prompt": "p", "completion": "c", "entry_scene": "S", "tags": [], "must_contain": [], "must_not_contain": []}
    wrong = good | {"case_id": "b", "tags": {"x": 1}, "prompt": 1.5, "entry_scene": True}
    del wrong["completion"]
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(wrong) + "\n")
    found = {(r["case_id"], r["field"], r["detail"]) for r in records.type_violations(spark, str(tmp_path / "r.jsonl")).collect()}
    assert found == {
        ("b", "tags", "must be list, got dict"), ("b", "prompt", "must be str, got float"),
        ("b", "entry_scene", "must be str, got bool"), ("b", "completion", "missing"),
    }


def test_source_spec():
    local, hub = SourceSpec(path="d.jsonl"), SourceSpec("hf", repo_id="org/set", config_name="c", revision="r")
    assert local.resolved("/base").path == "/base/d.jsonl" and SourceSpec.parse("x").path == "x"
    assert hub.describe() == "hf://org/set@r/c:train" and SourceSpec("hf", repo_id="o/s").describe() == "hf://o/s/default:train"
    # a new source keeps the hub details; a changed kind keeps the name
    assert hub.resolved("/b", source="org/new", split="test").describe() == "hf://org/new@r/c:test"
    assert hub.resolved("/b", kind="local").path == "/b/org/set"
    assert local.resolved("/b", kind="hf").describe() == "hf://d.jsonl/default:train"
    assert hub.resolved("/b", source="f.json", kind="local") == SourceSpec(path="/b/f.json")
    assert local.resolved("/b", source="/abs.json").path == "/abs.json"
    for bad in (SourceSpec(), SourceSpec("hf"), SourceSpec("ftp", path="x")):
        with pytest.raises(ValueError):
            bad.check()
    with pytest.raises(TypeError):
        SourceSpec.parse(3)


def test_build_export_and_variant(spark, files, tmp_path):
    (files / "all.jsonl").write_text("\n".join(json.dumps(c) for c in CASES))
    spec = SourceSpec(path=str(files / "all.jsonl"))
    manifest = datasets.build_dataset(spark, spec, str(tmp_path / "ds"), SplitSpec(0.5, 0.25, 1))
    assert manifest["counts"] == {"train": 6, "valid": 3, "test": 3} and manifest["split_seed"] == 1
    assert packages.read_manifest(spark, str(tmp_path / "ds/manifest")) == manifest
    package = datasets.export_dataset(spark, spec, str(tmp_path / "ex"), SplitSpec(0.5, 0.25, 1), exclude=["odd"], languages=["en"])
    assert package["counts"] == {"cases": 6, "chat": {"train": 3, "validation": 1, "test": 2}} and package["languages"] == ["en"]
    written = spark.read.json(str(tmp_path / "ex/cases"))
    assert "messages" not in written.columns and "extra" not in written.columns and "source_ref" in written.columns
    from pyspark.sql import types as T

    schema = T.StructType([*schemas.CASE.fields, T.StructField("split", T.StringType())])
    variant = packages.write_variant(spark, str(tmp_path / "ds"), str(tmp_path / "var"), ["odd"], schema)
    assert variant["counts"]["test"] == 3 and variant["counts"]["train"] <= 6 and variant["variant_exclude_tags"] == ["odd"]
    rows = spark.read.schema(schema).json(str(tmp_path / "var/records"))
    assert rows.filter("split != 'test' and array_contains(tags, 'odd')").count() == 0


def test_results_log(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = payloads.results_log_rows(spark.createDataFrame([("r1", 0.5)], "run_name string, test_loss double"))
    logs.append_results(rows, path)
    logs.append_results(rows.withColumn("run_name", F.lit("r2")), path)
    back = logs.read_results(spark, path)
    assert back.columns == schemas.RESULTS_LOG.names and {tuple(r)[:3] for r in back.collect()} == {("r1", None, 0.5), ("r2", None, 0.5)}
    header = next((tmp_path / "results").glob("*.csv")).read_text().splitlines()[0]
    assert header.split("\t") == schemas.RESULTS_LOG.names


def test_experiment_log(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("commit\tval_bpb\tmemory_gb\tstatus\tdescription\na\t1.5\tx\t keep \tfirst\nb\tcrashed\t2\tCrash\tsecond\n")
    rows = {r["commit"]: r for r in logs.read_experiments(spark, str(tmp_path / "e.tsv")).collect()}
    assert (rows["a"]["val_bpb"], rows["a"]["memory_gb"], rows["a"]["status"]) == (1.5, None, "KEEP")
    assert (rows["b"]["val_bpb"], rows["b"]["status"]) == (None, "CRASH")


def test_training_log(spark, tmp_path):
    lines = ["Iter 10: Val loss 2.0", "noise", "Iter 20: Train loss 9", "Iter 25: Val loss 1.5", "Iter 30: train"]
    rows = spark.createDataFrame([("r", i, line) for i, line in enumerate(lines)], "run_name string, n long, value string")
    assert [tuple(r) for r in logs.last_validation_loss(rows, "run_name", "n").collect()] == [("r", 25, 1.5)]
    chunks = spark.createDataFrame([("r", 0, "\n".join(lines)), ("r", 25, "no loss"), ("r", 50, lines[0])], "run_name string, done long, log string")
    assert sorted((r["step"], r["loss"]) for r in logs.chunk_losses(chunks, "run_name", "done").collect()) == [(25, 1.5), (60, 2.0)]


def test_shards(spark, tmp_path):
    for name, rows in (("shard_0", 3), ("shard_1", 2), ("shard_9", 4)):
        spark.range(rows).select(F.col("id"), F.col("id").cast("string").alias("text")).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    (tmp_path / "shard_2.parquet.tmp").write_text("half written")
    found = shards.read_shards(spark, str(tmp_path), "shard_9.parquet")
    assert shards.train_text(found).count() == 5 and shards.validation_text(found).count() == 4
    plan = found.filter("split = 'val'").select("text")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string>" in plan


def test_shards_that_are_folders(spark, tmp_path):
    for name, rows in (("a +%20b.parquet", 5), ("val.parquet", 3)):
        spark.range(rows).select(F.col("id").cast("string").alias("text")).repartition(3).write.parquet(str(tmp_path / name))
    spark.range(2).select(F.col("id").cast("string").alias("text")).toPandas().to_parquet(tmp_path / "c +%20d.parquet")
    paths = [str(tmp_path / name) for name in ("a +%20b.parquet", "val.parquet", "c +%20d.parquet")]
    found = shards.read_shards(spark, paths, "val.parquet")
    counted = {(r["shard"], r["split"]): r["count"] for r in found.groupBy("shard", "split").count().collect()}
    assert counted == {("a +%20b.parquet", "train"): 5, ("val.parquet", "val"): 3, ("c +%20d.parquet", "train"): 2}


def test_source_tree(spark, tmp_path):
    for name, text in {"a/one.py": "x = 1\n", "a/b/two.py": "y = 2", "a/test_one.py": "z", "a/__init__.py": "", "c/three.py": "n", "a/note.txt": "t", "a/o p+%.py": "q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    entry = {"name": "R", "repo_url": "u", "license": "MIT", "domain": "ml", "include_paths": ["a", "gone"], "ref": None}
    rows = {r["path"]: r["code"] for r in source_tree.read_repository(spark, str(tmp_path), entry).collect()}
    assert rows == {"a/one.py": "x = 1\n", "a/b/two.py": "y = 2", "a/o p+%.py": "q"}
    (tmp_path / "m.json").write_text(json.dumps([entry, {"name": "only"}]))
    with pytest.raises(ValueError, match="license"):
        source_tree.read_manifest(spark, str(tmp_path / "m.json"))
    (tmp_path / "a/scene.py").write_text("from manim import *\nclass S(Scene):\n    pass\n")
    cases = curation_plans.import_repositories(spark, [(str(tmp_path), entry)])
    assert [r["case_id"] for r in cases.collect()] == ["r-a-scene-py-s"]
    curation_plans.split_candidates(cases, str(tmp_path / "out"))
    assert (tmp_path / "out" / "candidate_set=plain").exists()


def test_source_tree_is_listed_in_tasks(spark, tmp_path):
    wanted = {"top.py", "a/one.py", "a/_own.py", "a/.hidden/two.py", "a/b/c/three.py", "b/four.py"}
    for name in wanted | {"a/b/test_x.py", "a/b/__init__.py", "a/b/c/note.txt", "a.py/five.txt"}:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x = '%d'\r\n" % len(name))
    everything = source_tree.read_sources(spark, f"file://{tmp_path}")
    assert "FileScan" not in everything._jdf.queryExecution().toString() and everything.inputFiles() == []
    assert {r["path"]: r["code"] for r in everything.collect()} == {name: f"x = '{len(name)}'\n" for name in wanted}
    some = source_tree.read_sources(spark, str(tmp_path), ["a/b", "/a/", "./b", "a", "../up", "top.py", "gone"])
    assert sorted(r["path"] for r in some.collect()) == sorted(wanted - {"top.py"})
    assert source_tree.read_sources(spark, str(tmp_path), []).count() == source_tree.read_sources(spark, str(tmp_path / "gone")).count() == 0


def test_split_files_are_compressed(spark, tmp_path):
    rows = spark.range(400).select("id", F.repeat(F.lit("word "), 500).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("split"))
    assert packages._counted_write(rows, str(tmp_path / "out"), "split", ["a", "b", "c"]) == {"a": 100, "b": 300, "c": 0}
    assert sum(f.stat().st_size for f in (tmp_path / "out").rglob("part-*")) < 400 * 2500 / 4
    back = spark.read.schema("id long, text string, split string").json(str(tmp_path / "out"))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_packages_and_their_sources_take_little_disk(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr("corpuslab.session.shared_dir", lambda _: str(tmp_path))
    for name in ("dataset_folder", "export_package", "variant_folder"):
        before = set(tmp_path.iterdir())
        assert getattr(source_queries, name)(spark, tables).count() in (3, 4)
        # What a query only read on its way is gone, what it made is there, and all records are compressed.
        (left,) = set(tmp_path.iterdir()) - before
        assert left.name.split("-")[0] == name.split("_")[0 if name != "export_package" else 1]
        parts = [p for p in left.rglob("part-*") if p.parent.name != "manifest"]
        assert parts and all(p.name.endswith(".json.gz") for p in parts)


def test_payload_report(spark, tmp_path):
    def write(name, **body):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))

    for name, score, render, syntax in (("A", .70, .80, .90), ("B", .70, .85, .85), ("C", .65, .95, 1.0)):
        write(name, run_name=name, summary={"num_cases": 21, "mean_case_score": score, "render_success_rate": render, "syntax_success_rate": syntax},
              cases=[{"case_id": "x", "syntax_ok": True}])
    write("D", run_name="D", error="boom")
    table = payloads.read_payloads(spark, str(tmp_path)).persist()
    entries = table.select(F.col("run_name").alias("name"), F.lit("api").alias("category"), "path")
    entries = entries.unionByName(spark.createDataFrame([("E", "api", "file:/nowhere.json")], "name string, category string, path string"))
    board, errors, consensus = evaluation_plans.benchmark_report(entries, table)
    assert [r["name"] for r in board.orderBy("rank").collect()] == ["B", "A", "C"]
    assert {r["name"]: r["error"] for r in errors.collect()} == {"D": "boom", "E": payloads.MISSING}
    assert tuple(consensus.first()) == ([21], 21)
    assert payloads.case_results(table).count() == 3
    table.unpersist()


def test_metric_projection(spark):
    rows = spark.createDataFrame([("r", 1.0, float("inf"), None, 3, True)], "run_name string, mean_case_score double, test_loss double, render_success_rate double, num_cases long, syntax_success_rate boolean")
    long = evaluation.finite_metrics(rows)
    assert {r["metric"]: r["value"] for r in long.collect()} == {"mean_case_score": 1.0, "num_cases": 3.0}
    assert [r["metric"] for r in evaluation.missing_metrics(long, rows, ["mean_case_score", "test_loss"]).collect()] == ["test_loss"]


def test_payloads_are_found_by_their_plain_paths(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, body in [("a b/x+1.json", '{"run_name": "x", "summary": {"num_cases": 3}}'), ("y.json", '{"run_name": "y"}')]:
        (tmp_path / name).write_text(body)
    table = payloads.read_payloads(spark, str(tmp_path))
    listed = [("x", f"{tmp_path}/a b/x+1.json"), ("uri", f"file://{tmp_path}/a b/x+1.json"), ("relative", "a b/x+1.json"), ("y", f"{tmp_path}/y.json"), ("gone", f"{tmp_path}/z.json")]
    entries = spark.createDataFrame([(n, "api", p) for n, p in listed], "name string, category string, path string")
    got = {r["name"]: (r["num_cases"], r["error"]) for r in payloads.report_entries(entries, table, str(tmp_path)).collect()}
    assert got == {"x": (3, None), "uri": (3, None), "relative": (3, None), "y": (None, payloads.NO_SUMMARY), "gone": (None, payloads.MISSING)}


OPEN = [
    {"case_id": "a", "prompt": "p", "completion": "x", "license": "MIT", "tags": ["t"], "messages": [{"role": "user", "content": "q"}], "verified": True, "odd name": {"k": [1, "é", None, 2.5]}, "n": None},
    {"case_id": "b", "prompt": "p", "completion": "y", "license": "MIT", "target_duration_seconds": 7, "verified": "yes", "big": 2**62},
    {"case_id": "c", "prompt": "p", "completion": "z", "license": "MIT"},
]


def test_unknown_fields_survive_a_rebuild_from_files(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(c) for c in OPEN[:1]) + "\n\n")
    (tmp_path / "two.json").write_text(json.dumps(OPEN[1:], indent=2))
    both = [str(tmp_path / "one.jsonl"), str(tmp_path / "two.json")]
    rows = records.read_open_cases(spark, both)
    assert rows.columns == [*schemas.CASE.names, records.REST] and rows.drop(records.REST).schema == schemas.CASE
    known = sorted(map(repr, rows.drop(records.REST).collect()))
    assert known == sorted(map(repr, records.read_cases(spark, both).collect()))
    path = str(tmp_path / "canonical")
    curation_plans.rebuild_canonical(spark, [(both[0], ["tier:gold"]), (both[1], ["tier:silver"])], path)
    written = {r["case_id"]: r for f in (tmp_path / "canonical").glob("part-*") for r in map(json.loads, f.read_text().splitlines())}
    for case in OPEN:
        for name, value in case.items():
            if name != "tags":
                assert written[case["case_id"]][name] == value
    assert written["a"]["tags"] == ["t", "tier:gold"] and "verified" not in written["c"] and written["c"]["entry_scene"] is None
    again = records.read_open_cases(spark, path)
    records.write_records(again, str(tmp_path / "third"), partition_by=["license"])
    third = {r["case_id"]: r for f in (tmp_path / "third/license=MIT").glob("part-*") for r in map(json.loads, f.read_text().splitlines())}
    assert third == {k: {n: v for n, v in r.items() if n != "license"} for k, r in written.items()}
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n{"case_id": \n')
    with pytest.raises(Exception):
        records.read_open_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_a_plan_that_runs_again_appends_once(spark, tmp_path):
    source, log, archive = (str(tmp_path / n) for n in ("v1", "log", "archive"))
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps(c) for c in OPEN))
    records.write_records(records.read_open_cases(spark, str(tmp_path / "cases.jsonl")), source)
    decide = lambda **given: spark.createDataFrame(list(given.items()), "case_id string, decision string")
    for _ in range(3):
        summary = curation_plans.apply_review(spark, source, decide(a="reject", b="promote"), str(tmp_path / "v2"), log, archive)
        assert (summary["num_promoted"], summary["num_rejected"]) == (1, 1)
    ids = lambda path: sorted(r["case_id"] for r in records.appended_ids(spark, path).collect())
    assert ids(log) == ["a", "b"] and ids(archive) == ["a"]
    archived = [json.loads(x) for f in (tmp_path / "archive").rglob("part-*") for x in f.read_text().splitlines()]
    assert archived[0]["odd name"] == OPEN[0]["odd name"]
    # Another plan sees the first one's batch.
    from corpuslab.operators import keys

    with pytest.raises(keys.CheckFailed, match="already applied.*: b"):
        curation_plans.apply_review(spark, str(tmp_path / "v2"), decide(b="reject"), str(tmp_path / "v3"), log, archive)
    curation_plans.apply_review(spark, str(tmp_path / "v2"), decide(c="reject"), str(tmp_path / "v3"), log, archive)
    assert ids(log) == ["a", "b", "c"] and ids(archive) == ["a", "c"]
    for _ in range(2):
        made = curation_plans.promote_candidates(spark, str(tmp_path / "v3"), decide(b="keep"), str(tmp_path / "promoted"), str(tmp_path / "rest"))
        assert made == {"num_promoted": 1, "num_remaining_candidates": 0}
    assert ids(str(tmp_path / "promoted")) == ["b"]


@pytest.mark.parametrize("range_bytes", [1, 40, 10_000])
def test_hub_lines_are_read_once_by_ranges(spark, tmp_path, range_bytes):
    folder = tmp_path / "org/set/main/default/train"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("\n".join(json.dumps(c) for c in CASES[:7]) + "\n\n")
    (folder / "b.json").write_text("\n" + "\n".join(json.dumps(c | {"prompt": "é" * 50}, ensure_ascii=False) for c in CASES[7:]))
    (folder / "_SUCCESS").write_text("")
    (folder / "empty.jsonl").write_text("")
    reader = hub.HubReader({"path": "org/set", "mirror": f"file://{tmp_path}", "range_bytes": str(range_bytes)}, schemas.CASE)
    parts = reader.partitions()
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(r["case_id"] for r in rows) == sorted(c["case_id"] for c in CASES) and (range_bytes > 40 or len(parts) > 20)
    assert all(r["prompt"] == "é" * 50 for r in rows if r["case_id"] in {c["case_id"] for c in CASES[7:]})


def test_hub_sources_in_plans(spark, tmp_path):
    mirror = str(tmp_path / "mirror")
    spark.createDataFrame([(c["case_id"], c["prompt"], c["completion"], c["license"], c["tags"], 5) for c in CASES], "case_id string, prompt string, completion string, license string, tags array<string>, other int").coalesce(1).write.parquet(f"{mirror}/org/set/r1/c/dev")
    source = SourceSpec("hf", repo_id="org/set", config_name="c", split="dev", revision="r1")
    rows, label = source.load(spark, mirror=mirror)
    assert label == "hf://org/set@r1/c:dev" and rows.schema == schemas.CASE and rows.count() == 12
    manifest = datasets.build_dataset(spark, source, str(tmp_path / "built"), SplitSpec(0.75, 0.125, 42), mirror=mirror)
    assert sum(manifest["counts"].values()) == 12
    assert datasets.export_dataset(spark, source, str(tmp_path / "package"), mirror=mirror)["counts"]["chat"]["train"] >= 9
    with pytest.raises(ValueError, match="mirror"):
        source.load(spark)
    with pytest.raises(Exception, match="the mirror holds no org/set/main/c/dev"):
        SourceSpec("hf", repo_id="org/set", config_name="c", split="dev").load(spark, mirror=mirror)[0].count()
