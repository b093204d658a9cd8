from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from corpuslab.operators import audit, code, curation, pages
from corpuslab.plans import curation as curation_plans
from corpuslab.plans import evaluation as evaluation_plans

TWO_SCENES = '''"""Doc  string."""
import os, numpy.linalg
from .shapes import Box
from . import other
from manim import *

SIZE = 3
print("dropped")
for i in range(3):
    pass

class Helper(VGroup):
    pass

class First(Scene):
    x = 1

class Second(lib.ThreeDScene):
    pass

if SIZE:
    y = 2
'''


def frame(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "id long, code string")


def test_profile(spark):
    rows = {r["id"]: r for r in code.profile(frame(spark, TWO_SCENES, "class A(Scene:\n", None, "class G(Scene[int]): pass", "x = 1\0")).collect()}
    two = rows[0]
    assert (two["syntax_ok"], two["scene_name"], two["scene_classes"]) == (True, "First", ["First", "Second"])
    assert two["imports"] == ["manim", "numpy.linalg", "os"] and two["local_imports"] == [".", ".shapes"]
    assert rows[1]["syntax_ok"] is False and "line 1" in rows[1]["syntax_message"] and rows[1]["scene_classes"] == []
    assert rows[2]["syntax_ok"] is None
    # a subscripted base counts for the audit only
    assert rows[3]["scene_name"] is None and rows[3]["scene_classes"] == ["G"]
    assert rows[4]["syntax_ok"] is False


def files(spark, *codes):
    return frame(spark, *codes).select(
        F.lit("My Repo").alias("name"), F.lit("https://example.org/r").alias("repo_url"), F.lit("MIT").alias("license"),
        F.lit("ml").alias("domain"), F.lit("v1").alias("ref"), F.concat(F.lit("src/f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), "code",
    )


def test_scene_cases(spark):
    plain = "import numpy as np\nfrom manim import *\nclass Only(Scene):\n    pass\n"
    rows = {r["case_id"]: r for r in code.scene_cases(files(spark, TWO_SCENES, "broken(", "x = 1", plain)).collect()}
    assert set(rows) == {"my-repo-src-f0-py-first", "my-repo-src-f0-py-second", "my-repo-src-f3-py-only"}
    first = rows["my-repo-src-f0-py-first"]
    assert first["completion"].startswith('"""Doc  string."""\nimport os, numpy.linalg\n') or "Doc  string." in first["completion"]
    assert "class First" in first["completion"] and "class Helper" in first["completion"] and "class Second" not in first["completion"]
    assert "dropped" not in first["completion"] and "for i" not in first["completion"] and "y = 2" in first["completion"]
    assert first["completion"].endswith("\n") and first["tags"] == ["repo-import", "ml", "my repo"]
    assert first["custom_imports"] == [".", ".shapes"] and first["uses_custom_library"] and first["requires_manual_conversion"]
    assert rows["my-repo-src-f3-py-only"]["is_plain_manim_candidate"] and not rows["my-repo-src-f3-py-only"]["uses_custom_library"]
    breakdown = {r["import_name"]: r["n_cases"] for r in curation.import_breakdown(code.scene_cases(files(spark, TWO_SCENES, plain))).collect()}
    assert breakdown == {".": 2, ".shapes": 2, "none": 1}


def test_plain_rules(spark):
    cases = [([], [], True), (["manim", "numpy.x"], [], True), (["manim_ml"], [], False), (["scipy"], [], False), ([], ["."], False), (["manimx"], [], False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id long, i array<string>, l array<string>")
    found = {r["id"]: r["p"] for r in rows.select("id", code.is_plain(F.col("i"), F.col("l")).alias("p")).collect()}
    assert found == {i: plain for i, (_, _, plain) in enumerate(cases)}


PAGE = """<html><h1 id=top>T</h1><script id="s">var p = "<pre>no</pre>";</script>
<div id="outer"><pre id="own">
    a = 1
      b &lt; 2 <span id="inside">x</span>
</pre></div><h2 id="top">again</h2><p id="two"><pre>class Demo(Scene):
    pass</pre><p id="late"></p></html>"""


def test_page_blocks():
    blocks = dict(pages.page_blocks(PAGE))
    first = "a = 1\n  b < 2 x"
    assert blocks["top"] == blocks["outer"] == blocks["s"] == first
    # an id counts from where its element starts, so a block is not after itself
    assert blocks["own"] == blocks["inside"] == blocks["two"] == "class Demo(Scene):\n    pass"
    assert blocks["late"] is None


def test_import_pages(spark):
    table = spark.createDataFrame([("u1", PAGE), ("u2", "<p id=a></p><pre>from manim import *\nclass Own(Scene): pass</pre>"), ("u3", None)], "url string, html string")
    manifest = spark.createDataFrame(
        [("c1", "u1", "two", "p", None), ("c2", "u2", "a", "p", None), ("c3", "u1", "late", "p", None), ("c4", "u1", "gone", "p", None),
         ("c5", "missing", "a", "p", None), ("c6", "u1", "top", "p", None), ("c7", "u1", "top", "p", "Given")],
        "case_id string, source_url string, source_anchor string, prompt string, entry_scene string",
    )
    rows = {r["case_id"]: r for r in pages.import_pages(manifest, table).collect()}
    assert rows["c1"]["completion"] == "from manim import *\n\nclass Demo(Scene):\n    pass" and rows["c1"]["entry_scene"] == "Demo"
    assert rows["c1"]["license"] == "MIT" and rows["c1"]["source_name"] == "c1" and rows["c1"]["tags"] == []
    assert rows["c2"]["completion"].count("import") == 1
    assert [rows[f"c{i}"]["problem"] for i in range(1, 8)] == [
        None, None, "no code block after anchor", "anchor not found", "anchor not found", "no scene class", None,
    ]
    assert rows["c7"]["entry_scene"] == "Given"


def test_pages_of_one_url(spark):
    table = spark.createDataFrame([(1, "u", "<p id=a></p><pre>class One(Scene)</pre>"), (2, "u", "<p id=a></p><pre>class Two(Scene)</pre><p id=b></p>"), (3, "u", None)], "page_id long, url string, html string")
    manifest = spark.createDataFrame([(f"{i}{a}", i, "u", a, "p") for i in (1, 2, 3) for a in "ab"], "case_id string, page_id long, source_url string, source_anchor string, prompt string")
    found = {r["case_id"]: (r["entry_scene"], r["problem"]) for r in pages.import_pages(manifest, table, version=["page_id"]).collect()}
    gone = (None, "anchor not found")
    assert found == {"1a": ("One", None), "1b": gone, "2a": ("Two", None), "2b": (None, "no code block after anchor"), "3a": gone, "3b": gone}
    every = [(r["case_id"], r["entry_scene"]) for r in pages.import_pages(manifest.drop("page_id"), table).collect()]
    assert len(every) == 6 and len({scene for case, scene in every if case.endswith("a")} & {"One", "Two"}) == 1


def test_lookup_of_pages_of_one_url(spark):
    table = spark.createDataFrame([(1, "u", "<title>1</title>"), (2, "u", "<title>2</title>"), (3, "u", None), (4, "v", "x")], "page_id long, url string, html string")
    manifest = spark.createDataFrame([(1, "u"), (2, "u"), (3, "u"), (4, "u"), (4, "v"), (5, None)], "page_id long, source_url string")
    titled = lambda found: sorted(((r["page_id"], r["source_url"], r["title"]) for r in pages.page_titles(found).collect()), key=repr)
    own = titled(pages.page_lookup(manifest, table, version=["page_id"]))
    assert own == [(1, "u", "1"), (2, "u", "2"), (3, "u", None), (4, "u", None), (4, "v", None), (5, None, None)]
    single = pages.page_lookup(manifest.drop("page_id"), table.drop("page_id")).collect()
    assert len(single) == 6 and len({r["html"] for r in single if r["source_url"] == "u"}) == 1 and all(r["html"] for r in single if r["source_url"])


def test_lookup_of_odd_pages_equals_its_sql(spark, tmp_path):
    """Pages without text, URL or id, several texts of one id, and line ends around a title."""
    rows = [
        (1, "u", "<title>\n a \t</title>"), (2, "u", None), (3, None, "<title>t</title>"), (4, "v", " <TITLE x>\u3000nb\xa0</TITLE>"), (5, "v", "<title>five</title>"),
        (6, "w", "<title>  </title>"), (7, "w", ""), (None, "z", "<title>null</title>"), (11, "d", "<title>A</title>"), (11, "d", "<title>B</title>"), (11, "d", None),
        (12, "e", "<title>same</title>"), (12, "e", "<title>same</title>"), (-1, "x", "<title>neg</title>"), (10, None, "<title>ten</title>"), (15, "", "x"), (16, "-gone", "y"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = connection.execute(oracle_sql()["page_lookup"]).fetchall()
    got = [tuple(r) for r in queries()["page_lookup"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_audit(spark):
    schema = "case_id string, prompt string, completion string, entry_scene string, tags array<string>, must_contain array<string>, must_not_contain array<string>, license string"
    good = "from manim import *\nclass A(Scene):\n    pass\n"
    staged = ["a", "b", "review-candidate", "tier:candidate", "status:unreviewed"]
    long = "draw " * 20
    rows = spark.createDataFrame([
        ("good", long + "1", good, "A", staged, ["Scene"], [""], "MIT"),
        ("Bad-Id", "Short one", "class A(", "A", ["x", " "], ["Circle"], ["class"], " "),
        ("twice", long + "same", good, "B", staged, [None], [], "MIT"),
        ("twice", long.upper() + "  SAME ", good, "A", staged, [], None, "MIT"),
    ], schema)
    known = spark.createDataFrame([("good",)], "case_id string")
    found = {(r["case_id"], r["severity"], r["rule"], r["detail"]) for r in curation_plans.audit_shard(rows, known).collect()}
    assert {f for f in found if f[0] == "good"} == {("good", "error", "already_canonical", ""), ("good", "error", "blank_element", "must_not_contain[0]")}
    assert {f[1:3] for f in found if f[0] == "Bad-Id"} == {
        ("error", "case_id_form"), ("error", "blank_element"), ("error", "missing_snippet"), ("error", "forbidden_snippet"),
        ("error", "syntax_error"), ("error", "entry_scene_not_found"), ("warning", "few_tags"), ("warning", "missing_staging_tag"),
        ("warning", "short_prompt"), ("warning", "missing_license"), ("warning", "missing_import_line"), ("warning", "scene_count"),
    }
    assert {f[1:] for f in found if f[0] == "twice"} == {
        ("error", "duplicate_id", ""), ("warning", "duplicate_prompt", ""), ("error", "entry_scene_not_found", "B"),
        ("error", "blank_element", "must_contain[0]"), ("error", "missing_field", "must_not_contain"),
    }
    assert not audit.passes(curation_plans.audit_shard(rows))
    lines = {r["message"] for r in audit.with_messages(curation_plans.audit_shard(rows, known)).collect()}
    assert {"twice: duplicate prompt text", "twice: entry_scene 'B' not found", "Bad-Id: has only 2 tags", "good: duplicate case_id already in canonical dataset"} <= lines
    assert None not in lines


def test_scoring_job(spark):
    rows = spark.createDataFrame([
        ("r", "ok", "```python\nclass A(Scene):\n    x.move_by(UP)\n```", ["shift"], ["move_by"], True),
        ("r", "failed", "class A(Scene):\n    self.play(a.become(b))\n", [], [], False),
        ("r", "no scene", "x = 1", ["y"], [], True),
        ("r", "broken", "class A(", None, None, True),
    ], "run_name string, case_id string, raw_response string, must_contain array<string>, must_not_contain array<string>, render_ok boolean")
    scored, summary = evaluation_plans.evaluate(rows.withColumn("render_log_tail", F.lit("Unexpected argument A passed to Scene.play()")))
    found = {r["case_id"]: r for r in scored.collect()}
    assert round(found["ok"]["weighted_score"], 9) == 1.0 and found["ok"]["normalization_notes"] == ["replace unsupported move_by with shift"]
    assert found["no scene"]["render_ok"] is None and found["no scene"]["scene_name"] is None
    assert found["broken"]["syntax_ok"] is False and found["broken"]["required_snippet_ratio"] == 1.0 and found["broken"]["forbidden_ok"] is True
    total = summary.first()
    assert (total["num_cases"], total["syntax_success_rate"], total["render_success_rate"]) == (4, 0.75, 0.5)
    # a filter on parsed results must not carry the parser into the plan a second time
    again = evaluation_plans.repair_failed(scored)
    assert [r["repaired_code"].count(".animate") for r in again.collect()] == [2]
    assert again._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_a_hot_group_of_copies_is_reported_whole(spark):
    """A third of all prompts say the same; every one of them is listed and none of the others."""
    rows = spark.range(900).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"),
        F.when(F.col("id") % 3 == 0, "Draw  the SAME thing ").otherwise(F.concat(F.lit("draw "), F.col("id").cast("string"))).alias("prompt"),
    )
    found = audit.duplicate_prompt_rows(rows)
    assert found.count() == 300 and found.select("prompt_hash").distinct().count() == 1


def test_repeated_scene_names_both_come_out(spark):
    twice = "class A(Scene):\n    x = 1\n\nclass A(Scene):\n    x = 2\n"
    rows = code.scene_cases(files(spark, twice)).collect()
    assert len(rows) == 2 and len({r["completion"] for r in rows}) == 2
