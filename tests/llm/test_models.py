"""Learned operators: exactness of their arithmetic, held-out accuracy and odd inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import common, decontamination, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, queries, secrets, toxicity, url_filter

SYLLABLES = {"aa": "ba be bi bo da de di do".split(), "zz": "xo xu zy zu vri vro kla klo".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Language


def test_code_lengths_are_those_of_the_escape_recursion(spark, monkeypatch):
    rng = random.Random(1)
    settings = language_id.Settings(order=2, least=1)
    rows = [(i, prose(rng, lang, 20), lang) for i, lang in enumerate(["aa", "zz"] * 6)]
    model = language_id.learn(frame(spark, rows, "doc_id long, text string, lang string"), settings)
    counts = {}
    for _, text, lang in rows:
        data = b"\0\0" + text.encode()
        for i in range(2, len(data)):
            for k in range(3):
                counts.setdefault((lang, data[i - k : i]), {}).setdefault(data[i], 0)
                counts[lang, data[i - k : i]][data[i]] += 1

    def bits(lang, context, b):
        seen = counts.get((lang, context))
        if seen is None:
            return bits(lang, context[1:], b) if context else 8.0
        n, q = sum(seen.values()), len(seen)
        if b in seen:
            return -np.log2(seen[b] / (n + q))
        return -np.log2(q / (n + q)) + (bits(lang, context[1:], b) if context else 8.0)

    texts = ["babe xoxu qqq", prose(rng, "aa", 9), "", "é?"]
    ((_, _, data_, offsets),) = common.arrow_slices(pa.array(texts))
    got = model.bits(data_, offsets)
    for t, row in zip(texts, got, strict=True):
        data = b"\0\0" + t.encode()
        want = [sum(bits(lang, data[i - 2 : i], data[i]) for i in range(2, len(data))) for lang in model.languages]
        assert np.allclose(row, want, rtol=1e-4), t
    monkeypatch.setattr(language_id, "BLOCK", 5)
    assert np.allclose(model.bits(data_, offsets), got)


def test_languages_of_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(["aa", "zz"] * 20)] + [(90, None, "aa"), (91, "x", None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    odd = frame(spark, [(1, None, "k"), (2, "", "k"), (3, "123 !?", "k"), (4, prose(rng, "zz", 40_000), "k"), (None, "BABE DODI", "k")], "doc_id long, text string, _guess string")
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [got[i]["_lang_pred"] for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "zz", "aa"]
    assert all(0 <= r["_lang_score"] <= 1 for r in got.values())
    assert language_id.learn(docs.limit(0)) is None
    assert {r["_lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


# Toxicity


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 3, 3, 4, 11])
    emission, moves = rng.normal(size=11), rng.normal(size=(2, 2))
    got, pairs = toxicity.forward_backward(emission, moves, first)
    want, want_pairs = np.zeros(11), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, on = 0.0, np.zeros(b - a)
        own = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(emission[a + i] for i in range(b - a) if y[i]) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1)))
            total += p
            on += p * np.array(y)
            for i in range(b - a - 1):
                own[y[i], y[i + 1]] += p
        want[a:b] = on / total if total else 0
        want_pairs += own / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_marginals_of_long_chains_match_short_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    emission, moves, first = rng.normal(size=700), rng.normal(size=(2, 2)), np.array([0, 5, 400, 400, 700])
    want = toxicity.forward_backward(emission, moves, first)
    monkeypatch.setattr(toxicity, "BLOCK", 1000)
    assert all(np.allclose(a, b) for a, b in zip(toxicity.forward_backward(emission, moves, first), want, strict=True))


def test_toxic_documents_and_spans(spark):
    rng = random.Random(3)
    bad = ["vileword", "grimpost", "grimlies"]
    rows, marks = [], []
    for i in range(400):
        w = prose(rng, "aa", 60).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w), "s"))
        marks.append((i, i % 4 == 0))
    docs = frame(spark, rows, "doc_id long, text string, score string")
    labels = frame(spark, [(i, int(t)) for i, t in marks if i < 300] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    extra = frame(spark, [(1000, None, "s"), (1001, "", "s"), (1002, "é grimpost babe", "s")], docs.schema)
    got = {r["doc_id"]: r["_toxicity"] for r in toxicity.score(docs.unionByName(extra), model).collect()}
    assert np.mean([(got[i]["score"] >= 0.5) == t for i, t in marks if i >= 300]) > 0.97
    assert [(s["start"], s["end"]) for s in got[1002]["spans"]] == [(2, 10)]
    assert got[1000]["score"] < 0.5 and got[1001]["score"] < 0.5 and not got[1000]["spans"]
    assert toxicity.learn(docs, labels.limit(0)) is None
    assert {r["_toxicity"]["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


# Decontamination


def test_leaks_and_paraphrases_are_found_and_others_left(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, "aa", rng.randint(15, 60))) for k in range(30)]
    rows = [(i, prose(rng, "aa", rng.randint(1, 400)), "x") for i in range(300)]
    planted = {}
    for k, (item, text) in enumerate(items):
        w = text.split()
        if k % 3 == 1:
            for j in range(0, len(w) * 3 // 4, 6):
                w[j] = "other"
        own = prose(rng, "aa", 150).split()
        at = rng.randint(0, 150)
        rows.append((1000 + k, " ".join(own[:at] + w + own[at:]), "x"))
        planted[1000 + k] = item
    docs = frame(spark, rows + [(5000, None, "x"), (5001, "", "x"), (5002, prose(rng, "aa", 30_000), "x")], "doc_id long, text string, item_id string")
    bench = frame(spark, [*items, (77, None), (78, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs.repartition(4), bench).collect()}
    assert got == set(planted.items())
    left = decontamination.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len(planted)
    blocks = decontamination.find_leaks(docs, bench, decontamination.Settings(block=7))
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_latent_space_of_decontamination_needs_no_sample(spark, tables, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(common, "bounded_sample", refused)
    docs, bench = spark.read.parquet(f"{tables}/documents.parquet").repartition(4), spark.read.parquet(f"{tables}/benchmark.parquet")
    pairs = lambda **bounds: {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench, decontamination.Settings(**bounds)).collect()}
    found, every = pairs(), pairs(cosine=-1.0)
    assert found <= every and len(found) >= 0.9 * len(every)


def test_latent_space_of_decontamination_is_that_of_all_documents(spark, monkeypatch):
    rng = random.Random(9)
    lexicon = sorted({prose(rng, lang, 1) for lang in ("aa", "zz") for _ in range(200)})
    # Words of one topic stand together in the documents; the items mix the topics.
    topics = [lexicon[k::25] for k in range(25)]
    docs = [(i, " ".join(rng.choice(lexicon if j % 9 == 0 else topics[i % 25]) for j in range(rng.randint(0, 150)))) for i in range(400)]
    items = [(k, " ".join(rng.choice(lexicon) for _ in range(40))) for k in range(60)]
    spaces, search = [], decontamination._search
    monkeypatch.setattr(decontamination, "DENSE", 20, raising=False)
    monkeypatch.setattr(decontamination, "DENSE_ROWS", 50, raising=False)
    monkeypatch.setattr(decontamination, "_search", lambda *given: spaces.append(given[:4]) or search(*given))
    tables = frame(spark, [*docs, (500, None)], "doc_id long, text string").repartition(7), frame(spark, items, "item_id long, text string")
    decontamination.find_leaks(*tables, decontamination.Settings(rank=24)).collect()
    ((found, idf, seen, basis),) = spaces
    rows = []
    for _, text in [*docs, *items]:
        words = text.split()
        for low in range(0, len(words), decontamination.PASSAGE):
            terms = found.index.find(decontamination._hashes(" ".join(words[low : low + decontamination.PASSAGE])))
            terms = terms[terms >= 0]
            rows.append(np.bincount(terms, minlength=len(idf)) * idf / max(np.sqrt((idf[terms] ** 2).sum()), 1e-12))
    passages, held = np.array(rows), [set(found.index.find(decontamination._hashes(text)).tolist()) for _, text in docs]
    assert seen.tolist() == [sum(t in words for words in held) for t in range(len(idf))]
    assert np.allclose(basis.T @ basis, np.eye(24), atol=1e-4)
    assert ((passages @ basis) ** 2).sum() > 0.98 * (np.linalg.svd(passages, compute_uv=False)[:24] ** 2).sum()


# Secrets


def brute_base(text):
    spans = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2]))))


def test_base_spans_and_learned_formats(spark):
    rng = random.Random(6)
    key = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for i in range(300):
        kind = i % 5
        secret = [f'token = "{key(40, "0123456789abcdef")}"', f"AKIA{key(16, 'ABCDEFGHIJ0123456789')}", f"Api_Key:'{key(12, 'xyz0129')}'", "password = x", "ſecret=abcdefgh"][kind]
        texts.append(f"é {prose(rng, 'aa', 30)} {secret} {prose(rng, 'aa', 30)}")
    texts += [None, "", "a" * 60_000, f"loose {key(40, '0123456789ABCDEF')} end", "SECRET=AKIA" + "A1" * 12]
    docs = frame(spark, [(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secrets.scan(docs, secrets.learn(docs)).select("doc_id", "_secrets.*").collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert {s for s in got[i]["spans"].split(",") if s and not s.startswith("format")} == {s for s in base.split(",") if s}, t
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(base.count(k) for k in ("assign", "access", "hex"))
    assert secrets.learn(docs.limit(0)) is None
    assert {r["_secrets"]["n_format"] for r in secrets.scan(docs, None).collect()} == {0}


def test_an_automaton_is_a_distribution():
    words = [b"12", b"1", b"123", b"1234", b"a1"] * 20
    automaton = secrets.Automaton(sorted(words), secrets.Settings())
    assert automaton.score([b"12"])[0] < automaton.score([b"zz"])[0]
    assert len(automaton.stop) <= 8


# Mixing


def test_rates_meet_targets_and_are_optimal(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    tokens = rng.integers(0, 400, 500)
    facts = frame(spark, [(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "_tokens long, _p array<double>")
    settings = mixing.Settings(targets={"a": 0.7, "b": 0.25, "c": 0.05})
    m = mixing.solve(facts, ["a", "b", "c"], settings)
    rate = np.maximum(0, 1 - p @ m)
    totals = (tokens * rate) @ p
    total = tokens.sum()
    assert np.allclose(totals / total, [0.7, 0.25, 0.05], atol=1e-2) and (rate >= 0).all()
    # Stationary: the gradient vanishes where a rate is positive and does not point inward where it is 0.
    gradient = p @ (totals - np.array([0.7, 0.25, 0.05]) * total) / total + settings.pull * (rate - 1)
    assert np.abs(gradient[rate > 0]).max() < 1e-5 and gradient[rate == 0].min(initial=0) > -1e-5


def test_mixing_of_odd_tables(spark):
    docs = frame(spark, [(1, "good words here", 5.0), (2, None, 5.0), (3, "", 5.0), (None, "more of it", 5.0), (1, "good words here", 5.0)], "doc_id long, text string, rate double")
    labels = frame(spark, [(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    rows, domains = mixing.mixed(docs, labels)
    got = rows.collect()
    assert domains == ["q1t0"] and len(got) == 5 and all(abs(r["rate"] - 1) < 1e-9 and r["copies"] == 1 for r in got)
    assert mixing.mixed(docs.limit(0), labels)[0].count() == 0
    rows, domains = mixing.mixed(docs, labels.limit(0))
    assert domains == ["all"] and rows.count() == 5


def test_the_mixing_query_is_native_and_separates_domains(spark, tables):
    rows = queries.op7_mixing(spark, tables)
    assert not re.search("Python|Arrow", rows._jdf.queryExecution().executedPlan().toString())
    found = rows.join(common.table(spark, tables, "labels"), "doc_id")
    right = found.where("quality = 1 and toxic = 0").agg(F.avg((F.col("p_q1t0") > 0.5).cast("int"))).first()[0]
    assert right > 0.9 and rows.where("rate < 0").count() == 0


# Pages and urls


def test_tree_marginals_match_enumeration():
    page = html_extract.Page("<div><p>one, two.</p><nav><a href='x'>l</a></nav></div><p>z</p>")
    rng = np.random.default_rng(3)
    bonds = rng.uniform(0.2, 2, (2, 2, 2))
    model = html_extract.Model(rng.normal(size=html_extract._WIDTH), bonds)
    (got,) = html_extract.marginals([page], model)
    odds, kind = html_extract.features(page) @ model.weights, html_extract._opens(page)
    total, on = 0.0, np.zeros(len(odds))
    for y in itertools.product((0, 1), repeat=len(odds)):
        p = np.exp(odds @ np.array(y)) * np.prod([bonds[kind[i], y[page.parents[i]], y[i]] for i in range(1, len(y))])
        total += p
        on += p * np.array(y)
    assert np.allclose(got, on / total)


def test_main_text_of_odd_pages(spark, tables):
    pages = common.table(spark, tables, "pages")
    model = html_extract.learn(pages)
    body = "A sentence of the text, and more of it to read. " * 6
    odd = [
        f"<nav><a href=''>x</a></nav><article><h1>T &amp; U</h1><p>{body}<br>a<b>b</b>c&eacute;<p>next  line<script>if (a < b) '</p>'</script></article><footer>f",
        None, "", "<", "<article>" + "<p>" + "word " * 50_000 + "</article>", "<div class='menu'><a href=''>only</a></div>",
        f"<main><p>{body}</p><div class='comments'><p>I agree, thanks.</p></div><aside><p>Read also this.</p></aside></main>",
    ]
    rows = frame(spark, [(i, h, "t") for i, h in enumerate(odd)], "page_id long, html string, text string")
    got = {r["page_id"]: r["_main_text"] for r in html_extract.extract(rows, model).collect()}
    text = " ".join(body.split())
    assert got[0] == f"T & U {text} a" + "bcé next line" and got[6] == text
    assert [got[i] for i in (1, 2, 3, 5)] == ["", "", "", ""] and len(got[4]) == 5 * 50_000 - 1
    assert html_extract.extract(rows.limit(0), html_extract.learn(pages.limit(0))).count() == 0


def test_main_text_matches_the_articles(spark, tables):
    import html

    def truth(page):
        inner = re.sub(r"</?(p|h1|br)>", "\n", re.search(r"<article>(.*?)</article>", page, re.S)[1])
        return " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())

    got = {r["page_id"]: r for r in queries.op4_main_text(spark, tables).collect()}
    for r in common.table(spark, tables, "pages").collect():
        assert got[r["page_id"]]["text"] == truth(r["html"]) and got[r["page_id"]]["n_chars"] == len(truth(r["html"]))


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("http://A.Net/x?y", "a.net", "/x", "net/"), ("http://net", "net", "", None), ("x://example.net/en/1#t", "example.net", "/en/1", "example.net/en/"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None), ("http://m.example.com/de/q", "m.example.com", "/de/q", "example.com/de/"),
        (None, "", "", None), ("no scheme/net/", "", "", None), ("http://a.org/fr/b://c", "a.org", "/fr/b://c", "org/fr/"), ("http://É.NET/", "É.net", "/", "net/"), ("http://h\n.net/", "h\n.net", "/", "net/"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    rows = frame(spark, [(url,)], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    r = rows.select("h", "p", url_filter.ruled(queries.URL_RULES, F.col("h"), F.col("p"))[0].alias("r")).first()
    assert (r["h"], r["p"], r["r"]) == (host, path, rule)


def test_urls_are_judged_by_rules_then_trees(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        bad = i % 2 == 0
        rows.append((i, f"http://{'bad' if bad and i < 300 else 'good' if i < 300 else 'other'}.site/{'9' * 30 if bad else 'word'}/{rng.randint(1, 9)}", 1.0))
    rows += [(900, None, 1.0), (901, "", 1.0), (902, "http://x.y/" + "a" * 50_000, 1.0)]
    pages = frame(spark, rows, "page_id long, url string, p_block double")
    rules = [("block", "bad.site/"), ("allow", "good.site/")]
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(rows) and all(got[i]["verdict"] == ("block" if i % 2 == 0 else "allow") for i in range(400))
    assert got[900]["host"] == "" and got[900]["verdict"] in ("block", "allow")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_secrets_of_letters_alone_are_scored():
    rng = random.Random(31)
    key = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(24))
    texts = [f"token = {key()} and then " + " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 14))) for _ in range(20)) for _ in range(80)]
    model = secrets.train(texts)
    found = [s for s in (model.extra(f"see {key()} here", []) for _ in range(50)) if s == [(4, 28, "format")]]
    assert len(found) >= 45
    assert model.extra("see internationalisation here", []) == []


def test_a_cut_value_does_not_end_where_it_is_cut():
    assert secrets.Automaton([b"a" * 100] * 50, secrets.Settings()).stop.min() > 6.3


def test_rates_equal_a_brute_force_least_squares(spark):
    rng = np.random.default_rng(17)
    for targets, seed in (({"a": 0.7, "b": 0.25, "c": 0.05}, 1), ({"a": 0.999, "b": 0.0005, "c": 0.0005}, 2), ({"a": 3.0, "b": 1.0}, 3)):
        p, tokens = rng.dirichlet([0.5, 0.3, 0.1 * seed], 120), rng.integers(0, 300, 120).astype(float)
        facts = frame(spark, [(int(t), [float(x) for x in row]) for t, row in zip(tokens, p, strict=True)], "_tokens long, _p array<double>").repartition(3)
        settings = mixing.Settings(targets=targets, pull=0.01, scale=1.0 if seed < 3 else 2.5)
        found = mixing.fit(facts, ["a", "b", "c"], settings)
        total = tokens.sum()
        wanted = np.array([targets.get(d, 0.0) for d in "abc"])
        wanted = wanted / wanted.sum() * settings.scale
        rate = np.ones(len(tokens))
        for _ in range(60_000):
            rate = np.maximum(0, rate - 0.9 * (p @ ((tokens * rate) @ p / total - wanted) + settings.pull * (rate - 1)))
        assert np.abs(np.maximum(0, 1 - p @ found.m) - rate)[tokens > 0].max() < 1e-4
        assert np.abs(found.residual - ((tokens * rate) @ p / total - wanted)).max() < 1e-6 and found.steps <= settings.steps
        assert np.allclose(found.targets, wanted)


CLASH = "_user _x _words _prob _length _guess _lettered _row _starts _of _at _one _tokens _p _rate _suffix _ruled host verdict n_lines".split()


def test_columns_with_an_operators_own_names_are_carried(spark, tables):
    made = {n: F.lit(-5.0 - k) for k, n in enumerate(CLASH)}
    docs = common.table(spark, tables, "documents").limit(60).select("doc_id", "text", "lang", "source").withColumns(made)
    labels = common.table(spark, tables, "labels")
    pages = common.table(spark, tables, "pages").select("page_id", "url").withColumns(made)
    kept = lambda rows, but=(): all(rows.where(F.col(n) != -5.0 - k).isEmpty() for k, n in enumerate(CLASH) if n not in but)
    assert kept(mixing.mixed(docs, labels)[0]) and kept(language_id.identify(docs, language_id.learn(docs)))
    assert kept(url_filter.judge(pages, queries.URL_RULES), ("host", "verdict"))
    benchmark = common.table(spark, tables, "benchmark")
    for rows in (exact_dedup.keep_first(docs), near_dedup.keep_one(docs), decontamination.without_leaks(docs, benchmark)):
        assert rows.columns == docs.columns and kept(rows) and rows.count() > 0
    lines = line_dedup.remove_repeats(docs)
    assert lines.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"] and kept(lines, ("n_lines",))


@pytest.mark.parametrize("pattern", ["<i>{n}</b>{n}", "<i>{n}<li>{n}", "<p><div><i>{n}<hr>{n}", "<i>{n}x</i>{n}", "<ul>{n}<li>a</td>{n}", "<b>x{n}", "<template>{n}", "<td>{n}</tr>{n}"])
def test_stray_and_deep_markup_takes_linear_time(pattern):
    import time

    head, _, tail = pattern.partition("{n}")
    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        page = html_extract.Page(head * n + tail.replace("{n}", "") * n)
        html_extract.main_text(page, np.ones(len(page.tags)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_stray_tags_close_nothing_else():
    page = html_extract.Page("<div><b>a</i></b></section><li>one<ul><li>two<li>three</ul><li>four<p>x<table><tr><td>y<td>z<tr><td>w</table><p>v<i>u<hr>t")
    parent = [page.tags[p] if p >= 0 else None for p in page.parents]
    assert list(zip(page.tags, parent, strict=True))[1:] == [
        ("div", "#root"), ("b", "div"), ("li", "div"), ("ul", "li"), ("li", "ul"), ("li", "ul"), ("li", "div"), ("p", "li"), ("table", "li"),
        ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("p", "li"), ("i", "p"),
    ]


def test_rare_suffixes_have_their_own_statistics(spark):
    rows = [(i, f"http://any.s{i % 600}/") for i in range(1800)]
    rows += [(5000 + i, f"http://{'abc' if i % 2 else 'bca'}.r{10 + i}/") for i in range(12)] + [(6000 + i, f"http://cab.r{10 + i}/") for i in range(12)]
    rules = [("block" if i % 2 else "allow", f"{'abc' if i % 2 else 'bca'}.r{10 + i}/") for i in range(12)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame(spark, rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows) and sum(got[6000 + i] == ("block" if i % 2 else "allow") for i in range(12)) >= 11
