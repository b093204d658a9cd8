from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.operators import corpus, packing


def slow_pack(docs, capacity, buffer_docs, refill):
    """Best fit by looking at every buffered document each time."""
    docs, buffer, rows, row, used, cropped = list(docs), [], [], [], 0, 0
    while True:
        while docs and len(buffer) < buffer_docs:
            buffer, docs = buffer + docs[:refill], docs[refill:]
        if not buffer:
            break
        fits = [d for d in buffer if len(d) <= capacity - used]
        pick = max(fits, key=len) if fits else min(buffer, key=len)
        at = next(i for i, d in enumerate(buffer) if d is pick)
        buffer.pop(at)
        cropped += max(0, len(pick) - (capacity - used))
        row, used = row + list(pick[: capacity - used]), min(capacity, used + len(pick))
        if used == capacity:
            rows.append((row, cropped))
            row, used, cropped = [], 0, 0
    return rows + ([(row, cropped)] if row else [])


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(2, 24), st.integers(1, 12), st.integers(1, 5))
def test_packing_equals_a_full_search(lengths, capacity, buffer_docs, refill):
    docs = [np.arange(100 * i, 100 * i + n, dtype=np.int32) for i, n in enumerate(lengths)]
    fast = [(ids.tolist(), cropped) for ids, _, cropped in packing.pack_documents(iter(docs), capacity, buffer_docs, refill)]
    assert fast == [([int(t) for t in row], cropped) for row, cropped in slow_pack(docs, capacity, buffer_docs, refill)]
    assert all(len(row) == capacity for row, _ in fast[:-1])
    assert sum(len(row) + cropped for row, cropped in fast) == sum(lengths)


def test_packed_rows(spark):
    docs = spark.range(200).select(F.col("id"), F.transform(F.sequence(F.lit(1), F.col("id") % 23 + 1), lambda i: i.cast("int")).alias("ids"))
    docs = docs.unionByName(spark.createDataFrame([(500, [7] * 100), (501, None), (502, [])], "id long, ids array<int>"))
    packed = packing.pack_sequences(docs, "id", "ids", 15, 0, partitions=3)
    rows = packed.collect()
    assert {r["part"] for r in rows} == {0, 1, 2}
    for r in rows:
        assert r["tokens"][0] == 0 and len(r["tokens"]) <= 16 and r["complete"] == (len(r["tokens"]) == 16)
    for part in range(3):
        assert [r["complete"] for r in rows if r["part"] == part].count(False) <= 1
        assert sorted(r["row_no"] for r in rows if r["part"] == part) == list(range(sum(r["part"] == part for r in rows)))
    totals = packing.packing_totals(packed).first()
    tokens_in = sum(len(r["ids"] or []) for r in docs.collect()) + docs.count()
    assert totals["tokens_placed"] + totals["tokens_cropped"] == tokens_in and totals["n_docs"] == 203


def test_pretokens_are_lossless(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("text", F.concat("text", F.lit("  it's  3456\n\n x　y…")).alias("hard"))
    for column in ("text", "hard"):
        assert docs.filter(F.array_join(corpus.pretokens(F.col(column)), "") != F.col(column)).count() == 0
    cut = spark.range(1).select(corpus.pretokens(F.lit("It's 3456  cats,\n ok"))).first()[0]
    assert cut == ["It", "'s", " ", "34", "56", " ", " cats", ",\n", " ok"]


def test_bytes(spark):
    words = spark.createDataFrame([("é",), ("<|reserved_1|>",), ("ab",)], "token string")
    assert {r["token"]: r["n_bytes"] for r in corpus.token_bytes(words).collect()} == {"é": 2, "<|reserved_1|>": 0, "ab": 2}
    losses = spark.createDataFrame([(1.0, 2), (9.0, 0), (2.0, 1)], "nats double, n_bytes int")
    assert abs(corpus.bits_per_byte(losses).first()["bits_per_byte"] - 3.0 / (np.log(2) * 3)) < 1e-12
    nothing = spark.createDataFrame([(9.0, 0)], "nats double, n_bytes int")
    assert corpus.bits_per_byte(nothing).first()["bits_per_byte"] is None


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(2, 24), st.integers(1, 12), st.integers(1, 5), st.booleans())
def test_every_token_has_one_place(lengths, capacity, buffer_docs, refill, crop):
    placed = list(packing.place_documents(iter(lengths), capacity, crop, buffer_docs, refill))
    used, ends = {}, {}
    for doc, begin, end, row, at in placed:
        assert at == used.get(row, 0) and begin == ends.get(doc, 0) <= end
        used[row], ends[doc] = at + end - begin + 1, end
    assert sorted(used) == list(range(len(used))) and all(used[r] == capacity for r in list(used)[:-1])
    assert set(ends) == set(range(len(lengths)))
    if crop:
        # The cropping form places what the packer of token rows places.
        docs = [np.full(n + 1, i, np.int32) for i, n in enumerate(lengths)]
        rows = [ids.tolist() for ids, _, _ in packing.pack_documents(iter(docs), capacity, buffer_docs, refill)]
        assert rows == [[d for d, b, e, r, _ in placed if r == row for _ in range(e - b + 1)] for row in range(len(rows))]
    else:
        assert all(ends[i] == n for i, n in enumerate(lengths))


def test_places_do_not_depend_on_the_layout(spark):
    docs = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.transform(F.sequence(F.lit(1), F.col("id") % 37 + 1), lambda i: i.cast("int")).alias("ids"))
    docs = docs.unionByName(spark.createDataFrame([("big", list(range(100))), ("null", None), ("empty", [])], "key string, ids array<int>"))
    made = [sorted(map(tuple, packing.place_sequences(docs.repartition(n), "key", "ids", 15, group_docs=70).collect())) for n in (1, 5)]
    assert made[0] == made[1] and len({r[3] for r in made[0]}) == 5
    placements = packing.place_sequences(docs, "key", "ids", 15, group_docs=70)
    rows = packing.placed_rows(placements, docs, "key", "ids", -1).collect()
    ids = {r["key"]: r["ids"] or [] for r in docs.collect()}
    tokens = {(r["part"], r["row_no"]): r["tokens"] for r in rows}
    assert all(t[0] == -1 and len(t) <= 16 for t in tokens.values()) and sum(len(t) < 16 for t in tokens.values()) <= 5
    for key, begin, end, part, row, at in made[0]:
        assert tokens[part, row][at : at + end - begin + 1] == [-1, *ids[key][begin:end]]
    assert packing.place_sequences(docs.limit(0), "key", "ids", 15).count() == 0
