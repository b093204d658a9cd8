"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

_STRINGS = T.ArrayType(T.StringType())

# Columns of a case that travel unchanged into chat and export records (fixed values, fixed order).
PASSTHROUGH = (
    ("source_name", T.StringType()),
    ("source_url", T.StringType()),
    ("source_anchor", T.StringType()),
    ("license", T.StringType()),
    ("source_domain", T.StringType()),
    ("source_repo_path", T.StringType()),
    ("source_ref", T.StringType()),
    ("imports", _STRINGS),
    ("local_imports", _STRINGS),
    ("custom_imports", _STRINGS),
    ("uses_custom_library", T.BooleanType()),
    ("is_plain_manim_candidate", T.BooleanType()),
    ("requires_manual_conversion", T.BooleanType()),
    ("target_duration_seconds", T.IntegerType()),
    ("target_duration_tolerance_seconds", T.IntegerType()),
)
PASSTHROUGH_COLUMNS = tuple(name for name, _ in PASSTHROUGH)

CASE = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("tags", _STRINGS),
        T.StructField("entry_scene", T.StringType()),
        T.StructField("must_contain", _STRINGS),
        T.StructField("must_not_contain", _STRINGS),
    ]
    + [T.StructField(name, kind) for name, kind in PASSTHROUGH]
)

RESULT = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("adapter_path", T.StringType()),
    T.StructField("skill_path", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("syntax_ok", T.BooleanType()),
    T.StructField("syntax_error", T.StringType()),
    T.StructField("scene_name", T.StringType()),
    T.StructField("required_snippet_ratio", T.DoubleType()),
    T.StructField("forbidden_ok", T.BooleanType()),
    T.StructField("render_ok", T.BooleanType()),
    T.StructField("render_log_tail", T.StringType()),
    T.StructField("weighted_score", T.DoubleType()),
    T.StructField("normalization_notes", _STRINGS),
    T.StructField("repair_attempts", T.IntegerType()),
    T.StructField("final_code", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("system_prompt", T.StringType()),
])

SUMMARY = T.StructType([
    T.StructField("num_cases", T.LongType()),
    T.StructField("syntax_success_rate", T.DoubleType()),
    T.StructField("render_success_rate", T.DoubleType()),
    T.StructField("mean_case_score", T.DoubleType()),
    T.StructField("test_loss", T.DoubleType()),
    T.StructField("test_perplexity", T.DoubleType()),
])

# An evaluation payload as one JSON document per run.
EVAL_PAYLOAD = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("backend", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("adapter_path", T.StringType()),
    T.StructField("skill_path", T.StringType()),
    T.StructField("dataset_dir", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("summary", SUMMARY),
    T.StructField("cases", T.ArrayType(T.StructType(
        [f for f in RESULT.fields if f.name not in {"run_name", "backend", "model", "adapter_path", "skill_path"}]
        + [T.StructField("code", T.StringType())]
    ))),
])

PAIR_RATING = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("notes", T.StringType()),
])

SAMPLE_RATING = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("notes", T.StringType()),
])

DOC_MANIFEST = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("source_anchor", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("entry_scene", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("tags", _STRINGS),
    T.StructField("must_contain", _STRINGS),
    T.StructField("must_not_contain", _STRINGS),
    T.StructField("target_duration_seconds", T.IntegerType()),
    T.StructField("target_duration_tolerance_seconds", T.IntegerType()),
])

REPO_MANIFEST = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("repo_url", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("include_paths", _STRINGS),
    T.StructField("ref", T.StringType()),
])

# Header of the tab-separated results log (fixed values, fixed order).
RESULTS_LOG = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("test_loss", T.DoubleType()),
    T.StructField("test_perplexity", T.DoubleType()),
    T.StructField("syntax_success_rate", T.DoubleType()),
    T.StructField("render_success_rate", T.DoubleType()),
    T.StructField("mean_case_score", T.DoubleType()),
    T.StructField("adapter_path", T.StringType()),
    T.StructField("eval_output_path", T.StringType()),
])

EXPERIMENT_LOG = T.StructType([
    T.StructField("commit", T.StringType()),
    T.StructField("val_bpb", T.DoubleType()),
    T.StructField("memory_gb", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("description", T.StringType()),
])
