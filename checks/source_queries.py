"""Round trips through the file formats: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views
from checks.case_queries import SPEC, SPLIT
from checks.registry import query
from corpuslab import schemas
from corpuslab.operators import evaluation
from corpuslab.plans import curation as curation_plans
from corpuslab.plans import datasets
from corpuslab.plans import evaluation as evaluation_plans
from corpuslab.session import removed, scratch_path
from corpuslab.sources import logs, packages, payloads, records
from corpuslab.sources.resolver import SourceSpec


def written_cases(spark, folder):
    """The cases as a folder of gzipped JSON lines; no licence is missing."""
    path = scratch_path(spark, "cases")
    rows = views.cases(spark, folder).withColumn("license", F.coalesce("license", F.lit("MIT")))
    records.write_records(rows, path, compression="gzip")
    return path


@query("case_files", f"""WITH {views.CASES}
SELECT case_id, prompt, completion, coalesce(license, 'MIT') AS license, array_to_string(tags, '|') AS tags, target_duration_seconds, CAST(NULL AS VARCHAR) AS entry_scene FROM cases_v""")
def case_files(spark, folder):
    return records.read_cases(spark, written_cases(spark, folder)).select(
        "case_id", "prompt", "completion", "license", F.array_join("tags", "|").alias("tags"), "target_duration_seconds", "entry_scene"
    )


@query("dataset_folder", f"""WITH {views.CASES}, {SPLIT}
SELECT split, count(*) AS n_rows, CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars FROM split_v GROUP BY split""")
def dataset_folder(spark, folder):
    """Build a dataset folder from case files and count what is in it."""
    source, path = written_cases(spark, folder), scratch_path(spark, "dataset")
    datasets.build_dataset(spark, SourceSpec(path=source), path, SPEC)
    removed(spark, source)
    written = spark.read.schema("case_id string, split string, messages array<struct<role:string,content:string>>").json(f"{path}/records")
    return written.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.char_length(F.get("messages", F.lit(1))["content"])).alias("prompt_chars")
    )


@query("export_package", f"""WITH {views.CASES}, {SPLIT}
SELECT 'cases' AS part, count(*) AS n_rows, CAST(sum(length(prompt)) AS BIGINT) AS prompt_chars, min(case_id) AS first_id, count(*) AS told FROM cases_v
UNION ALL SELECT CASE split WHEN 'valid' THEN 'validation' ELSE split END, count(*), CAST(sum(length(prompt)) AS BIGINT), min(case_id), count(*) FROM split_v GROUP BY split""")
def export_package(spark, folder):
    """What stands in the package's files, beside the counts that its own manifest tells."""
    source, path = written_cases(spark, folder), scratch_path(spark, "package")
    metadata = datasets.export_dataset(spark, SourceSpec(path=source), path, SPEC, pretty_name="Documents")
    removed(spark, source)
    told = F.create_map(*[F.lit(x) for pair in {"cases": metadata["counts"]["cases"], **metadata["counts"]["chat"]}.items() for x in pair])
    rows = spark.read.schema("case_id string, prompt string").json(f"{path}/cases").select(F.lit("cases").alias("part"), "case_id", "prompt")
    chat = spark.read.schema("case_id string, split string, messages array<struct<role:string,content:string>>").json(f"{path}/chat")
    rows = rows.unionByName(chat.select(F.col("split").alias("part"), "case_id", F.get("messages", F.lit(1))["content"].alias("prompt")))
    counted = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.char_length("prompt")).alias("prompt_chars"), F.min("case_id").alias("first_id"))
    return counted.withColumn("told", told[F.col("part")].cast("bigint"))


@query("variant_folder", f"""WITH {views.CASES}, {SPLIT}
SELECT split, count(*) AS n_rows FROM split_v WHERE split = 'test' OR NOT list_contains(tags, 'lang:es') GROUP BY split""")
def variant_folder(spark, folder):
    files, source, path = written_cases(spark, folder), scratch_path(spark, "dataset"), scratch_path(spark, "variant")
    datasets.build_dataset(spark, SourceSpec(path=files), source, SPEC)
    removed(spark, files)
    schema = T.StructType([*schemas.CASE.fields, T.StructField("split", T.StringType())])
    manifest = packages.write_variant(spark, source, path, ["lang:es"], schema)
    removed(spark, source)
    return spark.createDataFrame(sorted(manifest["counts"].items()), "split string, n_rows long")


@query("results_log", f"""WITH {views.SUMMARY}
SELECT run_name, test_loss, syntax_success_rate, render_success_rate, mean_case_score, CAST(NULL AS VARCHAR) AS base_model FROM summary_v
UNION ALL SELECT run_name, test_loss, syntax_success_rate, render_success_rate, mean_case_score, NULL FROM summary_v""")
def results_log(spark, folder):
    """The log is appended to twice."""
    rows = payloads.results_log_rows(views.summary(spark, folder)).coalesce(1).persist()
    path = scratch_path(spark, "results-log")
    for _ in range(2):
        logs.append_results(rows, path)
    rows.unpersist()
    return logs.read_results(spark, path).select(
        "run_name", "test_loss", "syntax_success_rate", "render_success_rate", "mean_case_score", "base_model"
    )


@query("payload_report", f"""WITH {views.SUMMARY},
entries AS (SELECT run_name AS name, CASE run_name WHEN 'line2' THEN 'no summary' END AS error, mean_case_score FROM summary_v
  UNION ALL SELECT 'gone', 'artifact missing', NULL)
SELECT name, error, CASE WHEN error IS NULL THEN mean_case_score END AS mean_case_score,
  CASE WHEN error IS NULL THEN row_number() OVER (PARTITION BY error IS NULL ORDER BY mean_case_score DESC) ELSE 0 END AS rank FROM entries""")
def payload_report(spark, folder):
    """Payload documents for each run, one of them without a summary, and an entry without a payload."""
    path = scratch_path(spark, "payloads")
    summary = views.summary(spark, folder)
    body = F.struct(
        "run_name",
        F.when(F.col("run_name") == "line2", "no summary").alias("error"),
        F.when(F.col("run_name") != "line2", F.struct("num_cases", "syntax_success_rate", "render_success_rate", "mean_case_score", "test_loss")).alias("summary"),
    )
    documents = summary.select(body.alias("b"), F.col("run_name").alias("run")).select("b.*", "run")
    documents.repartition("run").write.partitionBy("run").json(path)
    found = payloads.read_payloads(spark, path)
    # Entries name the written files by their plain paths.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    plain = F.regexp_replace("path", "^file:/+", "/")
    entries = files.select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("name"), F.lit("api").alias("category"), plain.alias("path")).unionByName(
        spark.range(1).select(F.lit("gone").alias("name"), F.lit("api").alias("category"), F.lit(f"{path}/gone.json").alias("path"))
    )
    board, errors, _ = evaluation_plans.benchmark_report(entries, found)
    return board.select("name", F.lit(None).cast("string").alias("error"), "mean_case_score", "rank").unionByName(
        errors.select("name", "error", F.lit(None).cast("double").alias("mean_case_score"), F.lit(0).cast("bigint").alias("rank"))
    )


@query("payload_cases", f"""WITH {views.RESULTS}
SELECT run_name, case_id, syntax_ok, scene_name, render_ok, round(weighted_score, 9) AS weighted_score FROM results_v""")
def payload_cases(spark, folder):
    """Results written as tables by run and read back."""
    path = scratch_path(spark, "results")
    scored = views.results(spark, folder)
    payloads.write_payloads(evaluation.run_summary(scored), scored, path)
    schema = "run_name string, case_id string, syntax_ok boolean, scene_name string, render_ok boolean, weighted_score double"
    return spark.read.schema(schema).json(f"{path}/cases").withColumn("weighted_score", F.round("weighted_score", 9))


@query("field_types", """
WITH r AS (SELECT 'e' || event_id AS case_id, event_type FROM events)
SELECT case_id, 'prompt' AS field, 'must be str, got int' AS detail FROM r WHERE event_type = 'view'
UNION ALL SELECT case_id, 'tags', 'must be list, got str' FROM r WHERE event_type = 'error'
UNION ALL SELECT case_id, 'entry_scene', 'must be str, got NoneType' FROM r WHERE event_type = 'click'
UNION ALL SELECT case_id, 'completion', 'missing' FROM r WHERE event_type = 'purchase'""")
def field_types(spark, folder):
    """Records with a field of the wrong type or none, by event type."""
    kind = F.col("event_type")
    good = {
        "case_id": F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('"')),
        "prompt": F.when(kind == "view", "7").otherwise('"p"'),
        "completion": F.when(kind != "purchase", '"c"'),
        "entry_scene": F.when(kind == "click", "null").otherwise('"S"'),
        "tags": F.when(kind == "error", '"a"').otherwise('["a"]'),
        "must_contain": F.lit("[]"), "must_not_contain": F.lit("[]"),
    }
    members = [F.concat(F.lit(f'"{name}": '), value) for name, value in good.items()]
    line = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    path = scratch_path(spark, "raw-records")
    views.table(spark, folder, "events").select(line.alias("value")).write.text(path)
    return records.type_violations(spark, path)


def mirrored(spark, folder):
    """The cases as a mirror of a hub: for each language a config, as lines for en and as Parquet for the others."""
    root = scratch_path(spark, "mirror")
    rows = views.cases(spark, folder).withColumn("license", F.coalesce("license", F.lit("MIT")))
    named = lambda lang: f"{root}/team/cases/v2/{lang}/train"
    has = lambda lang: F.array_contains("tags", f"lang:{lang}")
    records.write_records(rows.filter(has("en")), named("en"))
    rows.filter(~has("en")).write.parquet(named("others"))
    return root


@query("hub_source", f"""WITH {views.CASES}
SELECT case_id, prompt, completion, coalesce(license, 'MIT') AS license, array_to_string(tags, '|') AS tags, target_duration_seconds,
  'hf://team/cases@v2/' || CASE WHEN list_contains(tags, 'lang:en') THEN 'en' ELSE 'others' END || ':train' AS label FROM cases_v""")
def hub_source(spark, folder):
    """Two configs of a hub dataset, read through the data source, with the labels that a manifest shows."""
    mirror, found = mirrored(spark, folder), None
    for config in ("en", "others"):
        rows, label = SourceSpec("hf", repo_id="team/cases", config_name=config, revision="v2").load(spark, mirror=mirror)
        part = rows.select("case_id", "prompt", "completion", "license", F.array_join("tags", "|").alias("tags"), "target_duration_seconds", F.lit(label).alias("label"))
        found = part if found is None else found.unionByName(part)
    return found


@query("open_fields", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT c.case_id, d.source AS origin, d.n_chars AS size, CASE WHEN d.lang = 'en' THEN d.lang END AS only_en
FROM cases_v c JOIN documents d ON c.case_id = 'doc_' || d.doc_id
WHERE c.case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')""")
def open_fields(spark, folder):
    """Fields that the case schema does not know come through a rebuild from files."""
    docs = views.table(spark, folder, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("case_id"), F.col("source").alias("origin"),
        F.struct(F.col("n_chars").alias("size"), F.when(F.col("lang") == "en", F.col("lang")).alias("only_en")).alias("facts"),
    )
    rows = views.cases(spark, folder).withColumn("license", F.coalesce("license", F.lit("MIT"))).join(docs, "case_id")
    shards, path = [], scratch_path(spark, "canonical")
    for lang in ("en", "de", None):
        shard, has = scratch_path(spark, "shard"), F.array_contains("tags", f"lang:{lang or 'en'}")
        records.write_records(rows.filter(has if lang else ~has & ~F.array_contains("tags", "lang:de")), shard)
        shards.append((shard, ("tier:gold",)))
    rejected = views.reviews(spark, folder).filter(F.col("decision") == "reject")
    curation_plans.rebuild_canonical(spark, shards, path, rejected)
    facts = T.StructType([T.StructField("size", T.LongType()), T.StructField("only_en", T.StringType())])
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("origin", T.StringType()), T.StructField("facts", facts)])
    return records.read_cases(spark, path, schema).select("case_id", "origin", "facts.size", "facts.only_en")


@query("review_twice", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT 'log' AS part, case_id FROM reviews_v WHERE decision IN ('promote', 'reject') UNION ALL SELECT 'archive', case_id FROM reviews_v WHERE decision = 'reject'
UNION ALL SELECT 'dataset', case_id FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')""")
def review_twice(spark, folder):
    """A review that is applied again, as after a failure, appends its rows once."""
    dataset, new, log, archive = written_cases(spark, folder), *(scratch_path(spark, n) for n in ("reviewed", "log", "archive"))
    for _ in range(2):
        curation_plans.apply_review(spark, dataset, views.reviews(spark, folder), new, log, archive)
    ids = lambda part, path: records.appended_ids(spark, path).select(F.lit(part).alias("part"), "case_id")
    return ids("log", log).unionByName(ids("archive", archive)).unionByName(ids("dataset", new))
