"""Periodic runs, ranked search and packing against brute force, on odd inputs and on whole tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslab.llm import common, lexical_search, periodic_runs, queries, ranges, sequence_packing

DOC = "doc_id long, text string, _runs string, key string, n int"
ODD = [None, "", " \t\n", "a", "a " * 50, "a b a b", "É é É", "x" * 100_000, "w1 w2 w3 " * 20_000, "a b " * 3 + "c", "'s 't <|endoftext|> 1234́ ́"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts, ids=None):
    rows = [(i, t, "mine", "k", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def drawn_texts(rng, n):
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 12))]
            words += (part * rng.randint(1, 7))[: rng.randint(1, 70)]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    return out


# --- ranges ---------------------------------------------------------------------------------

def test_ranges_are_numbered_by_their_bytes(monkeypatch):
    texts = ["ab a ab", None, " bé ab ", "", "a"]
    ((_, _, data, offsets),) = common.arrow_slices(pa.array(texts))
    starts, ends, first = ranges.cut(data, offsets, ~ranges.SPACES)
    words = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert words == " ".join(t or "" for t in texts).encode().split() and list(first) == [0, 3, 3, 5, 5, 6]
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(ranges, "piecewise_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
        number, one = ranges.numbered(data, starts, ends)
        assert [words[one[k]] for k in number] == words and len(one) == len(set(words))
    out, at = ranges.gathered(data, starts, ends, first)
    assert [bytes(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [b" ".join((t or "").encode().split()) for t in texts]


# --- periodic runs --------------------------------------------------------------------------

def runs_by_hand(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(words[i : i + length - r] == words[i + r : i + length] for r in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_match_brute_force(spark):
    texts = drawn_texts(random.Random(5), 400) + [t for t in ODD if not t or len(t) < 1000]
    for row in periodic_runs.find_runs(docs(spark, texts).withColumnRenamed("_runs", "other")).collect():
        words = split(row["text"])
        want = runs_by_hand(words)
        assert [tuple(r) for r in row["_runs"]["runs"]] == want and row["_runs"]["n_words"] == len(words)
        assert row["_runs"]["collapsed"] == collapsed_by_hand(words, want) and (row["other"], row["n"]) == ("mine", 7)


def test_runs_on_odd_inputs(spark):
    got = {r["doc_id"]: r["_runs"] for r in periodic_runs.find_runs(docs(spark, ODD).drop("_runs")).collect()}
    assert got[0]["runs"] == got[1]["runs"] == got[2]["runs"] == [] and got[0]["collapsed"] == ""
    assert [tuple(r) for r in got[8]["runs"]] == [(0, 60_000, 3)] and got[8]["collapsed"] == "w1 w2 w3"
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 50, 1)] and got[7]["collapsed"] == "x" * 100_000
    same = periodic_runs.find_runs(docs(spark, ["a b " * 9] * 3, [None, 4, 4]).drop("_runs")).collect()
    assert [r["_runs"]["collapsed"] for r in same] == ["a b"] * 3
    assert periodic_runs.find_runs(docs(spark, []).drop("_runs")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.Settings(repeats=3)


def test_op13_matches_brute_force_over_the_whole_table(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, tables).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] for r in got)
    for row in got:
        words, h = split(texts[row["doc_id"]]), zlib.crc32(str(row["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert row["n_runs"] == len(runs) and row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert (row["start"], row["length"], row["period"]) == best
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


# --- ranked search --------------------------------------------------------------------------

def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked_by_hand(texts, items, best=10):
    bags = [(i, terms(t)) for i, t in texts]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in set(b))
    out = []
    for item_id, text in items:
        wanted, scored = terms(text), []
        for doc_id, bag in bags:
            tf, score = collections.Counter(bag), 0
            m = 25 + 75 * len(bag) * n_docs // n_terms if bag else 25
            for t in wanted:
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=repr)


def found_rows(frame):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect()), key=repr)


def test_search_matches_brute_force(spark):
    rng = random.Random(7)
    pool = ["alpha", "Beta", "gamma", "été", "x1", "of", "the", "nought"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(300)] + ["the of the"] * 400 + [t for t in ODD if t is None or len(t) < 1000]
    ids = [5 * i for i in range(len(texts))]
    ids[3] = ids[400] = None
    ids[10] = ids[11]
    items = [(1, "alpha, beta! gamma"), (2, "the the of"), (3, None), (4, "unheard"), (5, ""), (6, "ÉTÉ été x1"), (7, "nought"), (7, "gamma x1")]
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = ranked_by_hand(list(zip(ids, texts, strict=True)), items)
    for settings in (lexical_search.Settings(), lexical_search.Settings(block_items=2)):
        assert found_rows(lexical_search.search(docs(spark, texts, ids).repartition(5), table, settings)) == want
    assert found_rows(lexical_search.search(docs(spark, texts, ids), table, lexical_search.Settings(best=2))) == [r for r in want if r[1] <= 2]


def test_search_with_scores_beyond_doubles_and_wide_bags(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "EXACT", 1)
    monkeypatch.setattr(lexical_search, "CELLS", 40)
    texts, items = drawn_texts(random.Random(2), 120), [(1, "a b c a"), (2, "d e"), (3, "a")]
    want = ranked_by_hand(list(enumerate(texts)), items)
    scorer = lexical_search.Scorer([{0: 2}], np.array([3]))
    assert not scorer.exact and scorer.scores([np.array([0, 5], "<u4").tobytes()], np.array([100])).tolist() == [[2 * 3 * (5 * 10**9 // 5800)]]
    assert found_rows(lexical_search.search(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))) == want


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs(spark, []), items).collect() == []
    assert lexical_search.search(docs(spark, ["a"]), items.limit(0)).collect() == []
    assert lexical_search.search(docs(spark, [None, "", "--"]), items).collect() == []


def test_op12_matches_brute_force_over_the_whole_table(spark, tables):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert found_rows(queries.QUERIES["op12_lexical_search"](spark, tables)) == ranked_by_hand(texts, items)


# --- packing --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    with open(TOKENIZER, encoding="utf-8") as file:
        return file.read()


ALPHABET = "abcXYZ019.,;_<>|'\x00\x1c\x7f\x85\xa0\u2009ßÉé×÷µªÿŁİΣςσ́̈ーカ字😀ﬁ٣½ "


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    rng, plain = random.Random(4), Tokenizer.from_file(TOKENIZER)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["aaaaaaaaaaaaaaa the thethe banana It's DON'T they'll", "<|startoftext|>a<|endoftext|> b <|x", "x" * 5000, *(t or "" for t in ODD if not t or len(t) < 10_000)]
    texts += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 14))) for _ in range(50)) for _ in range(100)]
    made = sequence_packing.Encoder(tokenizer)
    for _ in range(2):
        for _, _, data, offsets in common.arrow_slices(pa.array(texts)):
            ids, first = made.ids(data, offsets, 7)
            for text, low, high in zip(texts, first[:-1], first[1:], strict=True):
                assert ids[low:high].tolist() == plain.encode(text, add_special_tokens=False).ids + [7], text


def test_another_kind_of_tokenizer_reads_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        made = sequence_packing.Encoder(file.read())
    ((_, _, data, offsets),) = common.arrow_slices(pa.array(["two words", None]))
    ids, first = made.ids(data, offsets, 9)
    assert made.merges is None and ids.tolist() == Tokenizer.from_file(path).encode("two words", add_special_tokens=False).ids + [9, 9] and first[1] == len(ids) - 1


def check_places(rows, capacity):
    taken = collections.defaultdict(list)
    for r in rows:
        taken[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in taken.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(taken)


def test_op11_pieces_are_the_tokens_of_whole_texts(spark, tables):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    got = queries.QUERIES["op11_sequence_packing"](spark, tables).collect()
    plain, by_doc = Tokenizer.from_file(TOKENIZER), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, rows in by_doc.items():
        ids = plain.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0]
        rows.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in rows] == [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert check_places(got, 2048) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_packing_of_odd_texts_gives_the_tokens_back(spark, tokenizer):
    ids = [None, 3, 3, *range(4, 4 + len(ODD) - 3)]
    plain, settings = Tokenizer.from_file(TOKENIZER), sequence_packing.Settings(capacity=64, group=50)
    want = collections.Counter()
    for i, t in zip(ids, ODD, strict=True):
        tokens = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((i, tuple(tokens[k : k + 64])) for k in range(0, len(tokens), 64))
    made = sequence_packing.sequences(docs(spark, ODD, ids), tokenizer, settings).collect()
    assert all(len(r["tokens"]) <= 64 for r in made)
    placed = sequence_packing.pack(docs(spark, ODD, ids), tokenizer, settings).collect()
    assert check_places(placed, 64) == len(made) and len(placed) == sum(want.values())
    crcs = collections.Counter()
    for (i, t), n in want.items():
        crcs[(i, len(t), zlib.crc32(np.array(t, "<u4").tobytes()))] += n
    assert collections.Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in placed) == crcs
    assert sum(len(r["tokens"]) for r in made) == sum(len(t) * n for (_, t), n in want.items())
    assert sequence_packing.pack(docs(spark, []), tokenizer).collect() == []


def pieces(spark, lengths):
    return spark.createDataFrame([(k, k, n) for k, n in enumerate(lengths)], "number long, doc_id long, length long")


@pytest.mark.parametrize("seed", range(3))
def test_packing_fills_sequences(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 1500) for _ in range(6000)]
    rows = sequence_packing.place(pieces(spark, lengths), sequence_packing.Settings(group=500)).collect()
    assert len(rows) == len(lengths) and check_places(rows, 2048) <= 1.004 * sum(lengths) / 2048 + 1


def test_pieces_that_do_not_fit_together_stay_alone(spark):
    rows = sequence_packing.place(pieces(spark, [1025] * 2000 + [2048] * 3), sequence_packing.Settings(group=100)).collect()
    assert check_places(rows, 2048) == 2003


def exhaustive(lengths, capacity):
    best = len(lengths)
    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            go(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, capacity - lengths[k]])
    go(0, [])
    return best


def test_local_search_against_all_packings():
    rng, more, improved = random.Random(11), 0, 0
    for _ in range(150):
        lengths = sorted((rng.randint(3, 14) for _ in range(rng.randint(5, 11))), reverse=True)
        bins = sequence_packing.Bins(lengths, 20)
        bins.given([[k] for k in range(len(lengths))])
        before = sum(f * f for f in bins.fill)
        bins.search()
        assert sorted(p for b in bins.bins for p in b) == list(range(len(lengths))) and max(bins.fill) <= 20
        assert bins.fill == [sum(lengths[p] for p in b) for b in bins.bins] and sum(f * f for f in bins.fill) >= before
        fit = sequence_packing.Bins(lengths, 20)
        fit.best_fit()
        before = len(fit.bins)
        fit.search()
        used = sum(1 for b in fit.bins if b)
        more += used - exhaustive(lengths, 20)
        improved += before > used
    assert more <= 1 and improved > 0
