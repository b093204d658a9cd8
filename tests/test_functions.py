from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import metrics, scoring, tags, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_strip_removes_what_python_strips(spark):
    raw = "　\x1c\t a b  \n\x85"
    assert value(spark, text.strip(F.lit(raw))) == raw.strip()
    assert value(spark, text.rstrip(F.lit(raw))) == raw.rstrip()


def test_normal_form(spark):
    assert value(spark, text.normal_form(F.lit("  Draw  a\n\tCIRCLE "))) == "draw a circle"


@pytest.mark.parametrize("raw, expected", [("My Run #1", "my-run-1"), ("--", "run"), ("", "run"), ("É2", "2")])
def test_slug(spark, raw, expected):
    assert value(spark, text.slug(F.lit(raw))) == expected


@pytest.mark.parametrize("raw, expected", [
    ("before\n```python\nclass Demo(Scene):\n    pass\n```\nafter ```x```", "class Demo(Scene):\n    pass"),
    ("```PYTHON x = 1```", "x = 1"),
    ("``` \n y \n```", "y"),
    ("```python\nnever closed", "```python\nnever closed"),
    ("  plain \n", "plain"),
    ("``````", ""),
    ("````a```", "`a"),
])
def test_extract_code(spark, raw, expected):
    assert value(spark, text.extract_code(F.lit(raw))) == expected


def test_prompt_composition(spark):
    both = value(spark, text.compose_system_prompt(F.lit("Base prompt. "), F.lit("# Skill body")))
    assert both == f"Base prompt.\n\n---\n\n{text.SKILL_HEADER}\n\n# Skill body"
    assert value(spark, text.compose_system_prompt(F.lit(" "), F.lit(None).cast("string"))) is None
    assert value(spark, text.compose_system_prompt(F.lit(None).cast("string"), F.lit("s"))).startswith(text.SKILL_HEADER)


def test_hardening_is_idempotent(spark):
    once = value(spark, text.harden_prompt(F.lit("Return runnable code. ")))
    assert text.HARDENING_SENTINEL in once and once.startswith("Return runnable code. Prefer")
    assert value(spark, text.harden_prompt(F.lit(once))) == once
    assert value(spark, text.harden_prompt(F.lit(None).cast("string"))) is None


def test_titles_and_prompts(spark):
    assert value(spark, text.spaced_title(F.lit("FadeInText"))) == "Fade In Text"
    prompt = value(spark, text.derived_prompt(F.lit("NeuralNet"), F.lit("ml"), F.lit("Repo")))
    assert "machine learning concept" in prompt and "`Neural Net`" in prompt and "`Repo`" in prompt
    assert value(spark, text.source_case_id(F.lit("My Repo"), F.lit("a/b.py"), F.lit("Demo"))) == "my-repo-a-b-py-demo"


@pytest.mark.parametrize("raw, expected", [
    ('" hi "', "hi"),
    ('[{"type":"text","text":" a "},"b",{"text":{"value":"c"}},{"type":"img","text":"no"},3]', "a\nb\nc"),
    ("[]", ""), ('{"a": 1}', None), ("7", None), ("not json", None),
])
def test_message_text(spark, raw, expected):
    assert value(spark, text.message_text(F.lit(raw))) == expected


@pytest.mark.parametrize("seconds, expected", [
    (None, None), (0, "duration:5s"), (6, "duration:5s"), (7, "duration:10s"), (22, "duration:20s"), (40, "duration:30s"), (41, "duration:50s"),
])
def test_duration(spark, seconds, expected):
    assert value(spark, tags.duration_tag(F.lit(seconds).cast("int"))) == expected


def test_tag_merge_keeps_order_and_repeats(spark):
    merged = tags.with_provenance(tags.string_array(["b", "a", "b"]), tags.string_array(["a", "z", "z"]), F.lit(5))
    assert value(spark, merged) == ["b", "a", "b", "z", "duration:5s"]
    no_tags = tags.with_provenance(F.lit(None).cast("array<string>"), tags.string_array(["x"]), F.lit(None).cast("int"))
    assert value(spark, no_tags) == ["x"]


def test_tag_filter(spark):
    have = tags.string_array(["a", "b"])
    for include, exclude, expected in [((), (), True), (("a", "b"), (), True), (("a", "c"), (), False), ((), ("c", "b"), False), (("a",), ("c",), True)]:
        assert value(spark, tags.matches(have, include, exclude)) is expected
    assert value(spark, tags.matches(F.lit(None).cast("array<string>"), (), ("a",))) is True


def test_promotion_tags(spark):
    staged = tags.string_array(["x", *tags.STAGING_TAGS, "status:approved"])
    assert value(spark, tags.promoted(staged)) == ["x", "status:approved", "tier:silver", "source:review-promotion"]


@pytest.mark.parametrize("render, syntax, scene, expected", [
    (True, True, "S", "Rendered"), (False, True, "S", "Render failed"), (None, True, None, "No scene detected"),
    (None, False, None, "Syntax error"), (None, None, "S", "Not attempted"), (None, True, "S", "Not attempted"),
])
def test_status(spark, render, syntax, scene, expected):
    column = scoring.case_status(F.lit(render).cast("boolean"), F.lit(syntax).cast("boolean"), F.lit(scene).cast("string"))
    assert value(spark, column) == expected


def test_snippets(spark):
    code = F.lit("class A(Scene): pass")
    assert value(spark, scoring.snippet_ratio(code, tags.string_array(["Scene", "Axes"]))) == 0.5
    assert value(spark, scoring.snippet_ratio(code, tags.string_array([]))) == 1.0
    assert value(spark, scoring.forbidden_ok(code, tags.string_array(["Axes"]))) is True
    assert value(spark, scoring.forbidden_ok(code, tags.string_array([""]))) is False


def _score(spark, render, weights=scoring.Weights()):
    return value(spark, scoring.weighted_score(
        F.lit(True), F.lit("S"), F.lit(0.5), F.lit(True), F.lit(render).cast("boolean"), weights
    ))


def test_weighted_score(spark):
    assert _score(spark, None) == pytest.approx((0.25 + 0.15 + 0.125 + 0.05) / 0.70)
    assert _score(spark, True) == pytest.approx(0.25 + 0.15 + 0.125 + 0.05 + 0.30)
    assert _score(spark, False) == pytest.approx(0.25 + 0.15 + 0.125 + 0.05)
    assert _score(spark, None, scoring.Weights(0, 0, 0, 0, 1)) == 0.0


def _decide(spark, base, cand):
    columns = [F.lit(v).cast("double") for v in (base[0], cand[0], base[1], cand[1], base[2], cand[2])]
    row = value(spark, scoring.ab_decision(*columns))
    return row["decision"], row["rationale"]


@pytest.mark.parametrize("base, cand, decision, line", [
    ((.70, .50, .45), (.52, .35, .68), "baseline", scoring.RENDER_REGRESSED),
    ((.70, .50, .45), (.52, .47, .68), "candidate", scoring.LOSS_IMPROVED),
    ((.70, .50, .45), (.699, .50, .50), "candidate", scoring.TIED_CANDIDATE),
    ((.70, .50, .45), (.699, .50, .40), "baseline", scoring.TIED_BASELINE),
    ((.70, .50, .45), (.80, .50, .90), "baseline", scoring.LOSS_REGRESSED),
    ((.70, .50, .45), (.695, .50, .90), "candidate", scoring.SCORE_CANDIDATE),
    ((None, .50, .45), (.52, .40, .90), "baseline", scoring.RENDER_REGRESSED),
    ((None, .50, .45), (.52, .50, .40), "baseline", scoring.SCORE_BASELINE),
    ((None, None, .45), (None, .50, .45), "tie", None),
    ((None, None, None), (None, None, .45), "tie", None),
])
def test_ab_decision(spark, base, cand, decision, line):
    found, rationale = _decide(spark, base, cand)
    assert found == decision
    assert line is None and rationale == [] or line in rationale


@pytest.mark.parametrize("base, tuned, lower, expected", [
    (None, 1.0, True, "n/a"), (1.0, 1.0 + 1e-12, True, "Tie"), (0.0, 1e-10, False, "Tie"),
    (1.0, 0.5, True, "Fine-tuned"), (1.0, 0.5, False, "Base"), (0.5, 1.0, False, "Fine-tuned"), (float("nan"), 1.0, True, "n/a"),
])
def test_metric_winner(spark, base, tuned, lower, expected):
    assert value(spark, scoring.metric_winner(F.lit(base).cast("double"), F.lit(tuned), F.lit(lower))) == expected


@pytest.mark.parametrize("number, whole, report", [
    (3.0, "3", "3.000"), (-2.0, "-2", "-2.000"), (0.0625, "0.062500", "0.062"), (0.7909, "0.790900", "0.791"), (None, None, "n/a"),
])
def test_metric_text(spark, number, whole, report):
    column = F.lit(number).cast("double")
    assert value(spark, metrics.metric_text(column)) == whole
    assert value(spark, metrics.report_text(column)) == report


@pytest.mark.parametrize("raw, expected", [
    ("a = 2.5", ("a", 2.5, None)), ("noeq", (None, None, "missing =")), (" =3", (None, None, "blank name")), ("k=1=2", (None, None, "not a number")),
])
def test_assignments(spark, raw, expected):
    assert tuple(value(spark, metrics.parse_assignment(F.lit(raw)))) == expected


def test_training_log_patterns(spark):
    assert value(spark, metrics.test_loss(F.lit("loss 3\nTest loss: 1.5"))) == 1.5
    assert value(spark, metrics.test_loss(F.lit("final loss= 2"))) == 2.0
    assert value(spark, metrics.test_loss(F.lit("train_loss 2"))) is None
    assert value(spark, metrics.test_perplexity(F.lit("ppl 4.2"))) == 4.2
    last = value(spark, metrics.last_validation_loss(F.lit("Iter 5: Val loss 2.5\nIter 10: Val loss 1.25, x")))
    assert tuple(last) == (10, 1.25)
    assert value(spark, metrics.last_validation_loss(F.lit("Iter 5: Train loss 2.5"))) is None


def test_category_labels(spark):
    found = [value(spark, metrics.category_label(F.lit(c))) for c in ("api_skill", "local_base", "other")]
    assert found == ["API model + skill", "Local base", "other"]


def test_decimals_are_those_of_the_exact_binary_value(spark):
    import random

    maker = random.Random(4)
    values = [0.0005, 0.0025, 0.0625, 0.0015, 1.0005, 2.5, 0.5, 1e-9, 999.9995, 123456.0005, -0.0005, -0.0625, -0.0001, 0.9999999, 1e15 + 0.5, 3.5e15, 1e21, -1e21]
    values += [maker.uniform(-10, 10) for _ in range(300)] + [round(maker.uniform(0, 100), 4) for _ in range(300)] + [maker.randrange(1 << 20) / 1024 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", metrics.half_even(F.col("v"), 3).alias("three"), metrics.half_even(F.col("v"), 6).alias("six")).collect()
    wrong = [(r["v"], r["three"], f"{r['v']:.3f}") for r in got if r["three"] != f"{r['v']:.3f}"] + [(r["v"], r["six"]) for r in got if r["six"] != f"{r['v']:.6f}"]
    assert wrong == []
    assert rows.select(metrics.report_text(F.lit(1e300))).first()[0] == "1.0E300"


@pytest.mark.parametrize("text, value", [("a=1d", None), ("a=0x1p3", None), ("a=1_000", 1000.0), ("a=1__0", None), ("a=_1", None), ("a= .5 ", 0.5), ("a=1.", 1.0), ("a=1e-3", 0.001), ("a=Infinity", float("inf")), ("a=1f", None), ("a=+2", 2.0)])
def test_numbers_follow_the_accepted_grammar(spark, text, value):
    assert spark.range(1).select(metrics.parse_assignment(F.lit(text)).alias("p")).first()["p"]["value"] == value
