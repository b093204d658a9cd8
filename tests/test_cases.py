from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.operators import canonical, cases, keys, splitting


def make(spark, rows):
    """Case rows from dictionaries; absent columns are null."""
    names = schemas.CASE.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.CASE)


def test_normalise_fills_from_messages(spark):
    messages = [("user", None), ("tool", "x"), ("user", "ask"), ("user", "again"), ("assistant", "answer"), ("system", "be brief")]
    row = cases.normalise(make(spark, [{"case_id": "a", "messages": messages}])).first()
    assert (row["system"], row["prompt"], row["completion"]) == ("be brief", "ask", "answer")
    assert row["tags"] == [] and row["must_contain"] == []


def test_normalise_keeps_present_fields_and_defaults_the_system(spark):
    row = cases.normalise(make(spark, [{"case_id": "a", "prompt": "p", "completion": "c", "messages": [("user", "other")]}])).first()
    assert row["prompt"] == "p" and row["system"] == cases.DEFAULT_SYSTEM_PROMPT


def test_violations(spark):
    found = cases.violations(cases.normalise(make(spark, [
        {"case_id": "ok", "prompt": "p", "completion": "c"},
        {"case_id": "blank", "prompt": "p", "completion": " 　\n"},
        {"case_id": "none"}, {"prompt": "p", "completion": "c"},
    ]))).collect()
    assert sorted((r["case_id"] or "", r["rule"], r["detail"]) for r in found) == [
        ("", "missing_key", "case_id"), ("blank", "empty_completion", "completion"),
        ("none", "missing_key", "completion"), ("none", "missing_key", "prompt"),
    ]


def test_prepare_checks(spark):
    good = [{"case_id": i, "prompt": "p", "completion": "c", "tags": [i]} for i in ("a", "b")]
    assert cases.prepare(make(spark, good), include=["a"]).count() == 1
    with pytest.raises(keys.CheckFailed, match="No dataset cases matched"):
        cases.prepare(make(spark, good), include=["z"])
    with pytest.raises(keys.CheckFailed, match="Duplicate case_id.*: a"):
        cases.prepare(make(spark, good + good[:1]))
    # a repeat that the filter drops is no error
    assert cases.prepare(make(spark, good + good[:1]), exclude=["a"]).count() == 1
    with pytest.raises(keys.CheckFailed, match="Unusable cases in x: c"):
        cases.prepare(make(spark, [*good, {"case_id": "c", "prompt": "p", "completion": " "}]), label="x")


def test_chat_and_export_records(spark):
    rows = cases.normalise(make(spark, [{"case_id": "a", "prompt": "p", "completion": "c", "source_ref": "r"}])).withColumn("extra", F.lit(1))
    chat = cases.chat_records(rows)
    assert chat.columns[:9] == ["case_id", "system", "prompt", "completion", "tags", "entry_scene", "must_contain", "must_not_contain", "messages"]
    assert chat.columns[9:] == list(schemas.PASSTHROUGH_COLUMNS)
    assert [(m["role"], m["content"]) for m in chat.first()["messages"]] == [("system", cases.DEFAULT_SYSTEM_PROMPT), ("user", "p"), ("assistant", "c")]
    assert "messages" not in cases.export_records(rows).columns


def test_license_preview(spark):
    rows = make(spark, [{"case_id": f"c{i:02}", "license": [None, " ", "MIT"][i % 3]} for i in range(30)])
    assert cases.license_gaps(rows).count() == 20
    with pytest.raises(keys.CheckFailed) as failure:
        keys.require_empty(cases.license_gaps(rows), "Missing")
    assert str(failure.value) == "Missing: " + ", ".join(f"c{i:02}" for i in range(15) if i % 3 != 2) + ", ..."
    assert {r["license"] for r in cases.with_default_license(rows).collect()} == {"MIT"}


def test_rebuild_gates_in_order(spark):
    shard = make(spark, [{"case_id": "a", "license": "MIT", "tags": ["x"], "target_duration_seconds": 9}, {"case_id": "b", "license": "MIT"}])
    other = make(spark, [{"case_id": "b", "license": "MIT"}])
    rejected = spark.createDataFrame([("b",), (None,)], "case_id string")
    with pytest.raises(keys.CheckFailed, match="Duplicate case_id while rebuilding"):
        canonical.rebuild([(shard, ["t"]), (other, [])])
    # rejects go before the duplicate check
    rebuilt = canonical.rebuild([(shard, ["t", "x"]), (other, [])], rejected).collect()
    assert [(r["case_id"], r["tags"]) for r in rebuilt] == [("a", ["x", "t", "duration:10s"])]
    # licences are checked before rejects are dropped
    unlicensed = make(spark, [{"case_id": "b"}])
    with pytest.raises(keys.CheckFailed, match="license metadata: b"):
        canonical.rebuild([(shard, []), (unlicensed, [])], rejected)
    with pytest.raises(keys.CheckFailed, match="while merging: b"):
        canonical.merge_shards([shard, other])


@pytest.mark.parametrize("rows, expected", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 1, 2)), (1000, (750, 125, 125))])
def test_split_counts(rows, expected):
    assert splitting.SplitSpec(0.75, 0.125).counts(rows) == expected


@given(st.integers(3, 10**6), st.floats(0, 1), st.floats(0, 1))
def test_split_counts_leave_no_split_empty(rows, train, valid):
    sizes = splitting.SplitSpec(train, valid).counts(rows)
    assert sum(sizes) == rows and min(sizes) >= 1


def test_split_counts_need_three():
    with pytest.raises(ValueError):
        splitting.SplitSpec().counts(2)


@settings(deadline=None, max_examples=6)
@given(st.integers(3, 400), st.integers(1, 5), st.sampled_from([1, 3, 20_000]))
def test_exact_split_is_a_sort_by_hash(spark, rows, seed, bucket_rows):
    """With tiny buckets the radix select has to go several levels down."""
    import hashlib

    spec = splitting.SplitSpec(0.6, 0.2, seed)
    ids = [f"case {i}" for i in range(rows)]
    before = splitting.BUCKET_ROWS
    splitting.BUCKET_ROWS = bucket_rows
    try:
        found = {r["case_id"]: r["split"] for r in splitting.exact_split(spark.createDataFrame([(i,) for i in ids], "case_id string"), spec).collect()}
    finally:
        splitting.BUCKET_ROWS = before
    ordered = sorted(ids, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    train, valid, _ = spec.counts(rows)
    assert found == {c: "train" if n < train else "valid" if n < train + valid else "test" for n, c in enumerate(ordered)}


def test_radix_select_refines_shared_prefixes(monkeypatch):
    """Histograms that share long prefixes: the cut is found inside the right bucket."""
    histogram = [("aaaa", 3), ("aaab", 2), ("bbbb", 5)]
    assert splitting._locate(histogram, "", 4) == ("aaab", 1, 2)
    assert splitting._locate(histogram, "aaa", 3) == ("aaab", 0, 2)
    assert splitting._locate(histogram, "bbbb", 4) == ("bbbb", 4, 5)


def test_variant_and_manifest(spark):
    rows = spark.createDataFrame(
        [("a", "train", ["x"]), ("b", "train", []), ("c", "valid", ["x"]), ("d", "test", ["x"])], "case_id string, split string, tags array<string>"
    )
    kept = splitting.split_variant(rows, ["x"])
    assert sorted(r["case_id"] for r in kept.collect()) == ["b", "d"]
    manifest = splitting.split_manifest(kept, "s", splitting.SplitSpec()).first()
    assert (manifest["train"], manifest["valid"], manifest["test"], manifest["split_seed"]) == (1, 0, 1, 42)
