"""The library's tables, taken from the given ones: once as DataFrames, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import evaluation

SNIPPETS = {"en": ("the", "and"), "de": ("die", "und"), "fr": ("de", "le"), "es": ("de", "la")}
MODELS = [f"line{i}" for i in range(1, 8)]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """One case per document: its first line is the prompt, the whole text the completion."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left")
    required = F.array().cast("array<string>")
    for lang, words in SNIPPETS.items():
        required = F.when(F.col("lang") == lang, strings(*words)).otherwise(required)
    tier = F.when(F.col("quality") == 1, "tier:gold").when(F.col("quality") == 0, "tier:silver")
    return docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("case_id"),
        F.substring_index("text", "\n", 1).alias("prompt"),
        F.col("text").alias("completion"),
        F.when(F.contains("text", F.lit("Apache License")), "Apache-2.0")
        .when(F.contains("text", F.lit("GNU General Public License")), "GPL-3.0")
        .when(F.col("source").isin("src0", "src1"), F.lit(None).cast("string")).otherwise("MIT").alias("license"),
        F.array_compact(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), tier)).alias("tags"),
        F.floor(F.col("n_chars") / 250).cast("int").alias("target_duration_seconds"),
        required.alias("must_contain"),
        strings("Licensed under").alias("must_not_contain"),
        F.lit(None).cast("string").alias("entry_scene"),
        F.col("source").alias("source_name"), F.col("lang").alias("source_domain"),
    )


CASES = """
cases_v AS (
  SELECT 'doc_' || CAST(d.doc_id AS VARCHAR) AS case_id, split_part(d.text, chr(10), 1) AS prompt, d.text AS completion,
    CASE WHEN contains(d.text, 'Apache License') THEN 'Apache-2.0'
         WHEN contains(d.text, 'GNU General Public License') THEN 'GPL-3.0'
         WHEN d.source IN ('src0', 'src1') THEN NULL ELSE 'MIT' END AS license,
    list_concat(['lang:' || d.lang, 'source:' || d.source],
      CASE l.quality WHEN 1 THEN ['tier:gold'] WHEN 0 THEN ['tier:silver'] ELSE [] END) AS tags,
    CAST(d.n_chars // 250 AS INTEGER) AS target_duration_seconds,
    CASE d.lang WHEN 'en' THEN ['the', 'and'] WHEN 'de' THEN ['die', 'und'] WHEN 'fr' THEN ['de', 'le']
      WHEN 'es' THEN ['de', 'la'] ELSE [] END AS must_contain,
    ['Licensed under'] AS must_not_contain,
    d.source AS source_name, d.lang AS source_domain
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("case_id"), "turn", "role", F.col("text").alias("content")
    )


TURNS = """
turns_v AS (
  SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS case_id, turn, role, text AS content FROM conversations)
"""


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    return labels.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("case_id"),
        F.when(F.col("quality") == 0, "reject").when(F.col("toxic") == 1, "skip").otherwise("promote").alias("decision"),
    )


REVIEWS = """
reviews_v AS (
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS case_id,
    CASE WHEN quality = 0 THEN 'reject' WHEN toxic = 1 THEN 'skip' ELSE 'promote' END AS decision FROM labels)
"""


def holdout(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("case_id"), "text"
    )


HOLDOUT = "holdout_v AS (SELECT 'bench_' || CAST(item_id AS VARCHAR) AS case_id, text FROM benchmark)"


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    """Events as an experiment log; the status is left untidy for the library to clean."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("campaign"), F.col("event_id").alias("idx"), F.col("value").alias("metric"),
        F.when(F.col("event_type") == "purchase", " keep").when(F.col("event_type") == "error", "CRASH").otherwise("Discard").alias("status"),
        F.concat("event_type", F.lit(":"), "props").alias("description"),
    )


EXPERIMENTS = """
explog_v AS (
  SELECT user_id AS campaign, event_id AS idx, value AS metric,
    CASE event_type WHEN 'purchase' THEN 'KEEP' WHEN 'error' THEN 'CRASH' ELSE 'DISCARD' END AS status,
    event_type || ':' || props AS description FROM events)
"""


def raw_results(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as per-case results; the same run and case may occur more than once."""
    return as_results(table(spark, folder, "lineitem"))


def as_results(item: DataFrame) -> DataFrame:
    return named_results(result_facts(item))


def result_facts(item: DataFrame) -> DataFrame:
    """What a line item says about its case, still under the table's own integer keys."""
    syntax_ok = F.col("l_returnflag") != "R"
    has_scene = syntax_ok & ~((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.08))
    return item.select(
        "l_linenumber", "l_orderkey", syntax_ok.alias("syntax_ok"), has_scene.alias("has_scene"),
        F.when(has_scene, F.col("l_discount") <= 0.05).alias("render_ok"),
        (F.col("l_quantity") / 50).alias("required_snippet_ratio"),
        (F.col("l_tax") <= 0.06).alias("forbidden_ok"),
        (F.col("l_tax") + F.col("l_discount")).alias("loss"),
    )


def named_results(facts: DataFrame) -> DataFrame:
    number = F.col("l_linenumber").cast("string")
    return facts.select(
        F.concat(F.lit("line"), number).alias("run_name"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("case_id"),
        "syntax_ok", F.when(F.col("has_scene"), F.concat(F.lit("Scene"), number)).alias("scene_name"),
        "render_ok", "required_snippet_ratio", "forbidden_ok", "loss",
    )


RAW_RESULTS = """
raw_results_v AS (
  SELECT 'line' || CAST(l_linenumber AS VARCHAR) AS run_name, 'o' || CAST(l_orderkey AS VARCHAR) AS case_id,
    l_returnflag <> 'R' AS syntax_ok,
    CASE WHEN l_returnflag <> 'R' AND NOT (l_linestatus = 'O' AND l_discount > 0.08)
      THEN 'Scene' || CAST(l_linenumber AS VARCHAR) END AS scene_name,
    CASE WHEN l_returnflag <> 'R' AND NOT (l_linestatus = 'O' AND l_discount > 0.08) THEN l_discount <= 0.05 END AS render_ok,
    l_quantity / 50 AS required_snippet_ratio, l_tax <= 0.06 AS forbidden_ok, l_tax + l_discount AS loss
  FROM lineitem)
"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One scored row per run and case."""
    every = lambda c: F.every(c).alias(c)
    one_each = result_facts(table(spark, folder, "lineitem")).groupBy("l_linenumber", "l_orderkey").agg(
        every("syntax_ok"), F.some("has_scene").alias("has_scene"), every("render_ok"),
        F.min("required_snippet_ratio").alias("required_snippet_ratio"), every("forbidden_ok"), F.min("loss").alias("loss"),
    )
    return evaluation.with_score(named_results(one_each))


SCORE = """
  CASE WHEN render_ok IS NULL THEN
    (0.25::DOUBLE * CAST(syntax_ok AS INTEGER) + 0.15::DOUBLE * CAST(scene_name IS NOT NULL AS INTEGER)
      + 0.25::DOUBLE * required_snippet_ratio + 0.05::DOUBLE * CAST(forbidden_ok AS INTEGER))
    / (0.25::DOUBLE + 0.15::DOUBLE + 0.25::DOUBLE + 0.05::DOUBLE)
  ELSE
    (0.25::DOUBLE * CAST(syntax_ok AS INTEGER) + 0.15::DOUBLE * CAST(scene_name IS NOT NULL AS INTEGER)
      + 0.25::DOUBLE * required_snippet_ratio + 0.05::DOUBLE * CAST(forbidden_ok AS INTEGER)
      + 0.30::DOUBLE * CAST(render_ok AS INTEGER))
    / (0.25::DOUBLE + 0.15::DOUBLE + 0.25::DOUBLE + 0.05::DOUBLE + 0.30::DOUBLE)
  END
"""
RESULTS = RAW_RESULTS + f""",
grouped_v AS (
  SELECT run_name, case_id, bool_and(syntax_ok) AS syntax_ok, min(scene_name) AS scene_name, bool_and(render_ok) AS render_ok,
    min(required_snippet_ratio) AS required_snippet_ratio, bool_and(forbidden_ok) AS forbidden_ok, min(loss) AS loss
  FROM raw_results_v GROUP BY ALL),
results_v AS (SELECT *, {SCORE} AS weighted_score FROM grouped_v)
"""
SUMMARY = RESULTS + """,
summary_v AS (
  SELECT run_name, count(*) AS num_cases,
    round(avg(CAST(syntax_ok AS DOUBLE)), 6) AS syntax_success_rate,
    round(avg(CAST(render_ok AS DOUBLE)), 6) AS render_success_rate,
    round(avg(weighted_score), 6) AS mean_case_score, round(avg(loss), 6) AS test_loss
  FROM results_v GROUP BY run_name)
"""
RATES = ("syntax_success_rate", "render_success_rate", "mean_case_score", "test_loss")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Run summaries with a loss, rates rounded so that summation order cannot show."""
    return rounded(evaluation.run_summary(results(spark, folder), extra=[F.avg("loss").alias("test_loss")]), RATES)


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns if c in df.columns})


# Python sources that Spark writes from the documents: by language a file with one scene and an
# outside package, one with two scenes and a custom library, one that does not parse, and one with a
# local import and no scene. The whole text goes in as a comment.
def modules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text").select(
        "doc_id", "lang", "source", F.concat(F.lit("# "), F.regexp_replace("text", "[\\r\\n]+", "\n# ")).alias("comment")
    )
    number = F.col("doc_id").cast("string")
    by_lang = {
        "en": F.concat(
            F.lit("from manim import *\nimport numpy as np\n\nLIMIT = 3\n\nclass Doc"), number,
            F.lit("(Scene):\n    def construct(self):\n        self.add(Text('x').move_by(RIGHT))\n"),
        ),
        "de": F.concat(
            F.lit("from manim import *\nimport manim_ml.layers\n\nclass First"), number,
            F.lit("(ThreeDScene):\n    pass\n\nclass Second"), number,
            F.lit("(manim.MovingCameraScene):\n    pass\n\nprint('left out')\n"),
        ),
        "fr": F.concat(F.lit("from manim import *\nclass Doc"), number, F.lit("(Scene)\n    pass\n")),
        "es": F.concat(F.lit("from . import shapes\nfrom scipy.stats import norm\n\nclass Doc"), number, F.lit("(VGroup):\n    pass\n")),
    }
    code = F.lit("")
    for lang, text in by_lang.items():
        code = F.when(F.col("lang") == lang, text).otherwise(code)
    return docs.select(
        F.concat(F.lit("doc_"), number).alias("case_id"), "doc_id", "lang", "source",
        F.concat("comment", F.lit("\n"), code).alias("code"),
    )
