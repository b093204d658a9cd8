"""Exact, near and line dedup against brute force and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from corpuslab.llm import decontamination, exact_dedup, line_dedup, near_dedup

DOC = "doc_id long, text string, kept string, n int"


def docs(spark, texts, ids=None):
    rows = [(i, t, "mine", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 100, 3000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 1 << 50, n).astype(np.uint64))
    width, quotients, remainders = exact_dedup.golomb(values, 1 << 50)
    assert (exact_dedup.ungolomb(len(values), width, quotients, remainders) == values).all()
    assert len(quotients) + len(remainders) < 8 * len(values) + 2


def test_exact_copies_match_brute_force(spark):
    rng = random.Random(3)
    pool = [sentence(rng, 5) for _ in range(40)] + [None, "", " ", "a  b", "a\tb", "a\x0bb", "a b", "x" * 200_000]
    texts = [rng.choice(pool) for _ in range(600)] + ["hot"] * 1500
    ids = [i * 3 for i in range(len(texts))]
    want = collections.defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        want[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = exact_dedup.find_copies(docs(spark, texts, ids).repartition(6)).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    for body, own in want.items():
        for i in own:
            r = by_id[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), i == min(own))
            assert r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()
    assert exact_dedup.keep_first(docs(spark, texts, ids)).count() == len(want)


def test_exact_copies_of_odd_tables(spark):
    assert exact_dedup.find_copies(docs(spark, [])).collect() == []
    rows = exact_dedup.find_copies(docs(spark, ["a", "a", "b", "b"], [None, 4, 5, 5])).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["kept"]) for r in rows) == [("4", 4, True), ("5", 5, True), ("5", 5, True), ("None", 4, False)]
    assert exact_dedup.keep_first(docs(spark, ["a", "a"])).columns == ["doc_id", "text", "kept", "n"]


def shingles(text):
    words = re.findall(r"\w+", text.lower())
    seen, out = collections.Counter(), set()
    for j in range(max(1, len(words) - 4)) if words else ():
        k = tuple(words[j : j + 5])
        out.add((k, seen[k]))
        seen[k] += 1
    return out


def brute_classes(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def near_texts(rng):
    texts = []
    for _ in range(25):
        base = sentence(rng, rng.randint(60, 250)).split()
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = "edited"
            if rng.random() < 0.3:
                del w[10:14]
            texts.append(" ".join(w))
    base = sentence(rng, 120).split()
    for k in range(60):
        w = list(base)
        w[(k * 7) % 120] = f"v{k}"
        texts.append(" ".join(w))
    return texts + ["", None, "...", "three words only", "Three, words: only!", "one", "same same same same same same same", "same same same same same same"]


def test_near_copies_match_brute_force(spark):
    rng = random.Random(5)
    texts = near_texts(rng)
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in near_dedup.find_classes(docs(spark, texts).repartition(5)).collect()}
    want = brute_classes(texts)
    assert len(got) == len(texts)
    wrong = [i for i in range(len(texts)) if got[i]["class_id"] != want[i]]
    assert len(wrong) <= 0.02 * len(texts), wrong
    sizes = collections.Counter(r["class_id"] for r in got.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_near_copies_of_odd_tables(spark):
    assert near_dedup.find_classes(docs(spark, [])).collect() == []
    rows = near_dedup.find_classes(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 2, 2, 9])).collect()
    assert sorted((str(r["doc_id"]), r["class_id"]) for r in rows) == [("2", 2), ("2", 2), ("9", 9), ("None", None)]
    assert near_dedup.keep_one(docs(spark, ["a b c d e f g", "A b c d e f g!", "x y z"])).orderBy("doc_id").select("doc_id").collect() == [(0,), (2,)]


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        x, y = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert near_dedup.common_in_band(np.array(x), np.array(y), 50) == lcs(x, y)
    assert near_dedup.common_in_band(np.array([9, 1, 2, 3]), np.array([1, 2, 3, 8]), 0) == 0
    assert near_dedup.common_in_band(np.array([9, 1, 2, 3]), np.array([1, 2, 3, 8]), 1) == 3


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w == ("", "", ""):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)
    return out


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(8)
    passage = [sentence(rng, 4) for _ in range(6)]
    texts = []
    for k in range(200):
        lines = [rng.choice(["", "x", "y", sentence(rng, 2)]) for _ in range(rng.randint(0, 12))]
        if k % 3 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[rng.randint(0, 2) :]
        texts.append("\n".join(lines))
    texts += [None, "", "a\nb", "r\nr\nr\nr\nr", "\n\n\n\n"]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(docs(spark, texts).repartition(4)).collect()}
    for i, (text, gone) in brute_lines(list(enumerate(texts))).items():
        assert (got[i]["text"], got[i]["n_removed"], got[i]["kept"]) == (text, gone, "mine"), i


def test_repeated_lines_of_odd_tables(spark):
    assert line_dedup.remove_repeats(docs(spark, [])).collect() == []
    rows = line_dedup.remove_repeats(docs(spark, ["a\nb\nc", "a\nb\nc"], [None, 1])).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: "a\nb\nc", None: ""}


def edited(rng, words, n, mark):
    out = list(words)
    for k, at in enumerate(rng.sample(range(5, len(words) - 5), n)):
        out[at] = f"{mark}x{k}"
    return out


def test_near_copies_of_a_centre_that_is_not_the_smallest_id_are_one_class(spark):
    rng = random.Random(21)
    centre = sentence(rng, 200).split()
    texts = [" ".join(edited(rng, centre, 4, f"w{i}")) for i in range(300)]
    texts[150] = " ".join(centre)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find_classes(docs(spark, texts).repartition(4)).collect()}
    assert set(got.values()) == {0}


def test_pairs_among_texts_of_one_template_are_found_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    rng = random.Random(22)
    template = sentence(rng, 200).split()
    texts, want = [], {}
    for i in range(60):
        own = template[:150] + sentence(rng, 50).split()
        for w in (own, edited(rng, own, 1, f"w{i}")):
            want[len(texts)] = len(texts) // 2 * 2
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.find_classes(docs(spark, texts).repartition(4)).collect()}
    assert got == want


def test_the_rest_of_large_buckets_holds_every_similar_pair(spark):
    rng = random.Random(23)
    template, texts = sentence(rng, 150).split(), []
    for i in range(25):
        own = template[: rng.randint(90, 140)] + sentence(rng, rng.randint(5, 50)).split()
        texts += [" ".join(own), " ".join(edited(rng, own, rng.randint(0, 5), f"w{i}") + sentence(rng, rng.randint(0, 9)).split())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = rows.select("doc_id", near_dedup._worded()(rows["text"]).alias("words"))
    settings = near_dedup.Settings()
    placed = rows.selectExpr("1L AS key", "doc_id AS rep", "doc_id AS root", "50L AS n")
    got = {(r["a"], r["b"]) for r in near_dedup._rest(placed, near_dedup._open(placed), near_dedup._prefixed(words, settings), settings).collect()}
    sets = [shingles(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) >= 10 and want <= got and len(got) < 2 * len(want) + 100


def test_prefixes_list_no_kmer_that_one_text_alone_has(spark):
    rng = random.Random(25)
    template = sentence(rng, 150).split()
    texts = [" ".join(edited(rng, template, 4, f"w{i}")) for i in range(60)] + [sentence(rng, 80), "", "one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    words = rows.select("doc_id", near_dedup._worded()(rows["text"]).alias("words"))
    got = {r["doc_id"]: r for r in near_dedup._prefixed(words, near_dedup.Settings()).collect()}
    holders = collections.Counter(k for t in texts for k in shingles(t))
    for i, text in enumerate(texts):
        own = [holders[k] for k in shingles(text)]
        most = len(own) - int(np.ceil(0.8 * len(own) - 1e-9)) + (len(own) > 0)
        # a collision of slots may list one
        assert got[i]["size"] == len(own) and 0 <= min(most, own.count(1)) - got[i]["lone"] <= 1, i
        assert len(got[i]["prefix"]) == most - got[i]["lone"], i
    assert sum(r["lone"] for r in got.values()) > sum(len(r["prefix"]) for r in got.values())


def test_filters_drop_rows_by_id_and_text(spark):
    rng = random.Random(24)
    a, b, c, item = (sentence(rng, 60) for _ in range(4))
    left = lambda rows: sorted((str(r["doc_id"]), r["text"]) for r in rows.collect())
    table = docs(spark, [a, a, b, b.replace(" ", "  "), c, c], [1, None, None, 7, 7, 9])
    assert left(exact_dedup.keep_first(table)) == sorted([("1", a), ("7", b.replace(" ", "  ")), ("7", c)])
    near = docs(spark, [a, a + " more", b, c, b + " again", item], [1, 5, 5, None, 6, 5])
    assert left(near_dedup.keep_one(near)) == sorted([("1", a), ("5", b), ("None", c), ("5", item)])
    leaky = docs(spark, [f"{a} {item} {b}", c, f"{b} {item} {c}", a], [3, 3, None, None])
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert left(decontamination.without_leaks(leaky, benchmark)) == sorted([("3", c), ("None", a)])
