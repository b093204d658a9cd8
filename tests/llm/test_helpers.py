"""Sampling, id filters, skewed joins, components and words against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.llm.words import HashIndex, words_of


def hashed(text: str) -> list[tuple[str, int]]:
    data = np.frombuffer(text.encode(), np.uint8)
    low, start, end, hashes, _ = words_of(data, np.array([0, len(data)]))
    return [(bytes(low[a:b]).decode(), int(h)) for a, b, h in zip(start, end, hashes, strict=True)]


def test_words_are_folded_runs_of_letters_and_digits():
    text = "Über den ÉTÉ—straße, 3×4 a_b “x”  \n"
    assert [w for w, _ in hashed(text)] == ["über", "den", "été", "straße", "3×4", "a", "b", "x"]


def test_a_words_hash_depends_on_the_word_alone():
    a, b = dict(hashed("one two three")), dict(hashed("zzz THREE yy two"))
    assert a["three"] == b["three"] and a["two"] == b["two"] and len(set(a.values())) == 3


def test_words_do_not_cross_texts():
    texts = ["ab", "", "cd ef", None, "g"]
    ((low, high, data, offsets),) = common.arrow_slices(pa.array(texts))
    _, start, end, _, first = words_of(data, offsets)
    assert (low, high) == (0, 5) and list(first) == [0, 1, 1, 3, 3, 4]
    assert [bytes(data[a:b]) for a, b in zip(start, end, strict=True)] == [b"ab", b"cd", b"ef", b"g"]


def test_slices_cover_long_and_short_texts():
    texts = ["x" * n for n in (3, 50, 0, 7, 200, 1)]
    seen = []
    for low, high, data, offsets in common.arrow_slices(pa.array(texts), most=20):
        seen += [bytes(data[offsets[i] : offsets[i + 1]]).decode() for i in range(high - low)]
    assert seen == texts


def test_hash_index_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert index.find(np.zeros(0, np.uint64)).shape == (0,)


def test_a_sample_is_bounded_and_stable(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("k"), F.lit("x" * 10).alias("t"))
    first = common.bounded_sample(rows, F.col("k"), "id", F.length("t"), 100, 500)
    again = common.bounded_sample(rows.repartition(7), F.col("k"), "id", F.length("t"), 100, 500)
    got = sorted(r["id"] for r in first.collect())
    assert got == sorted(r["id"] for r in again.collect())
    assert len(got) == 100 and sum(i % 3 == 0 for i in got) == 50
    assert common.bounded_sample(rows.limit(0), F.col("k"), "id", F.length("t"), 5, 5).count() == 0


def test_only_and_without_are_exact(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(500)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in (3, 7, 499, 9999, None)], "doc_id long")
    inside = sorted(r["text"] for r in common.only(rows, ids).collect())
    outside = sorted(r["text"] for r in common.without(rows, ids).collect())
    expected = sorted(f"t{i}" for i in range(500) if not i % 10 or i in (3, 7, 499))
    assert inside == expected and sorted(inside + outside) == sorted(f"t{i}" for i in range(500))
    nothing = ids.limit(0)
    assert common.only(rows, nothing).count() == 0 and common.without(rows, nothing).count() == 500


def test_a_hot_key_joins_like_any_other(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k % 2 = 0")
    got = common.join_skewed(rows, keyed, "k", "n", 6000)
    assert got.count() == 6000 and got.where("n = 4000").count() == 4000 and got.where("n is null").count() == 1000


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_held_out_is_crc32_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_a_sample_takes_one_row_of_a_hot_key(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "id % 2 = 0 AS k", "CAST(id AS string) AS t", "map(id, id) AS _of", "id AS _at")
    for size in (10, 1000, 5000):
        got = common.bounded_sample(rows.repartition(5), F.col("k"), "id", F.length("t"), size, 10**6)
        found = got.collect()
        assert got.columns == rows.columns and len(found) == len({(r["id"], r["k"]) for r in found})
        assert max(sum(r["k"] == k for r in found) for k in (True, False)) <= size
        again = common.bounded_sample(rows.repartition(3), F.col("k"), "id", F.length("t"), size, 10**6).collect()
        assert sorted(r["t"] for r in found) == sorted(r["t"] for r in again)


def test_fresh_names_and_wrapped_rows(spark):
    assert common.fresh(["_a", "__A", "b"], "_a", "b", "c", "c") == ["___a", "_b", "c", "_c"]
    rows = spark.createDataFrame([(1, "x", 2)], "doc_id long, _user string, `a.b` int")
    made = common.wrapped(rows, "doc_id", without=("a.b",)).withColumn("more", F.lit(1))
    assert made.select("_user.*", "more").collect() == [(1, "x", 1)]


def test_compact_keeps_the_rows(spark):
    rows = spark.range(1000).repartition(50)
    made = common.compact(rows, 1000, 100)
    assert made.rdd.getNumPartitions() == 10 and made.count() == 1000
