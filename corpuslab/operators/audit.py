"""Static audit of a candidate shard: every rule is a row, errors and warnings alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.tags import STAGING_TAGS, or_empty
from corpuslab.functions.text import blank_to_null, normal_form, strip
from corpuslab.operators import keys

CASE_ID_FORM = "^[a-z0-9][a-z0-9_]*$"
SHORT_PROMPT = 80
IMPORT_LINE = "from manim import *"
REQUIRED = ("case_id", "prompt", "completion", "entry_scene", "tags", "must_contain", "must_not_contain")
LISTS = ("tags", "must_contain", "must_not_contain")

_FINDING = "struct<severity:string,rule:string,detail:string>"


def _finding(severity: str, rule: str, detail: Column | str = "") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), detail.alias("detail"))


def _one(condition: Column, severity: str, rule: str, detail: Column | str = "") -> Column:
    return F.filter(F.array(F.when(condition, _finding(severity, rule, detail))), lambda f: f.isNotNull()).cast(f"array<{_FINDING}>")


def _each(values: Column, bad, severity: str, rule: str) -> Column:
    """A finding for each element of a list that is bad, named by the element."""
    return F.transform(F.filter(or_empty(values), bad), lambda v: _finding(severity, rule, F.coalesce(v, F.lit("")))).cast(
        f"array<{_FINDING}>"
    )


def _blank_elements(name: str) -> Column:
    """A finding for each list element that is null or blank, named by its position."""
    numbered = F.transform(F.col(name), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    bad = F.filter(numbered, lambda e: F.coalesce(strip(e["v"]) == "", F.lit(True)))
    return F.coalesce(
        F.transform(bad, lambda e: _finding("error", "blank_element", F.concat(F.lit(f"{name}["), e["i"].cast("string"), F.lit("]")))),
        F.array(),
    ).cast(f"array<{_FINDING}>")


def record_findings(df: DataFrame, min_tags: int = 5, profiled: bool = False) -> DataFrame:
    """``(case_id, severity, rule, detail)`` for the rules that need the record alone.

    With ``profiled`` the table also holds ``syntax_message`` and ``scene_classes``, and the rules
    on the parsed code apply. All rules are evaluated in one pass over the table.
    """
    completion, case_id = F.col("completion"), F.col("case_id")
    tags = F.col("tags")
    groups = [_one(F.col(name).isNull(), "error", "missing_field", name) for name in REQUIRED]
    groups += [_blank_elements(name) for name in LISTS]
    groups += [
        _one(~F.rlike(case_id, F.lit(CASE_ID_FORM)), "error", "case_id_form"),
        _each(F.when(completion.isNotNull(), F.col("must_contain")), lambda s: ~F.contains(completion, s), "error", "missing_snippet"),
        _each(
            F.when(completion.isNotNull(), F.col("must_not_contain")),
            lambda s: (s != "") & F.contains(completion, s), "error", "forbidden_snippet",
        ),
        _one(F.size(or_empty(tags)) < min_tags, "warning", "few_tags", F.size(or_empty(tags)).cast("string")),
        *[
            _one(~F.coalesce(F.array_contains(tags, tag), F.lit(False)), "warning", "missing_staging_tag", tag)
            for tag in STAGING_TAGS
        ],
        _one(F.char_length(strip(F.col("prompt"))) < SHORT_PROMPT, "warning", "short_prompt"),
        _one(blank_to_null(F.col("license")).isNull(), "warning", "missing_license"),
        _one(~F.contains(completion, F.lit(IMPORT_LINE)), "warning", "missing_import_line"),
    ]
    if profiled:
        scenes = F.col("scene_classes")
        groups += [
            _one(F.col("syntax_message").isNotNull(), "error", "syntax_error", F.col("syntax_message")),
            _one(~F.coalesce(F.array_contains(scenes, F.col("entry_scene")), F.lit(False)), "error", "entry_scene_not_found", F.col("entry_scene")),
            _one(F.size(scenes) != 1, "warning", "scene_count", F.array_join(scenes, ", ")),
        ]
    return df.select("case_id", F.explode(F.flatten(F.array(*groups))).alias("f")).select("case_id", "f.severity", "f.rule", "f.detail")


def duplicate_prompt_hashes(df: DataFrame) -> DataFrame:
    """Hash of the normal form of each prompt that occurs more than once.

    Only the 64-character hash is shuffled, counted on the map side first; never the prompt.
    """
    hashed = df.select(F.sha2(normal_form(F.col("prompt")), 256).alias("prompt_hash"), (normal_form(F.col("prompt")) != "").alias("_text"))
    return keys.duplicate_keys(hashed.filter("_text"), "prompt_hash")


def duplicate_prompt_rows(df: DataFrame) -> DataFrame:
    """The rows whose prompt repeats, with their prompt hash."""
    repeated = duplicate_prompt_hashes(df).select("prompt_hash")
    return df.withColumn("prompt_hash", F.sha2(normal_form(F.col("prompt")), 256)).join(repeated, "prompt_hash", "left_semi")


def _repeated(df: DataFrame, canonical: DataFrame | None) -> DataFrame:
    """The findings that look at other rows: ids and prompts that repeat in the shard, and ids that are canonical.

    All three are one count of narrow keys, combined before the shuffle, and one join of the keys with what was found.
    """
    prompt = normal_form(F.col("prompt"))
    kinds = F.array_compact(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("case_id").alias("key")),
        F.when(prompt != "", F.struct(F.lit("prompt").alias("kind"), F.sha2(prompt, 256).alias("key"))),
    ))
    entries = df.select("case_id", F.explode(kinds).alias("e")).select("case_id", "e.kind", "e.key")
    held = entries.select("kind", "key", F.lit(False).alias("known"))
    if canonical is not None:
        held = held.unionByName(canonical.select(F.lit("id").alias("kind"), F.col("case_id").alias("key"), F.lit(True).alias("known")))
    counted = held.groupBy("kind", "key").agg(F.count_if(~F.col("known")).alias("n"), F.bool_or("known").alias("known"))
    met = entries.join(counted.filter((F.col("n") > 1) | F.col("known")), ["kind", "key"])
    rule = lambda severity, name: F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))
    rules = F.array_compact(F.array(
        F.when((F.col("kind") == "id") & (F.col("n") > 1), rule("error", "duplicate_id")), F.when(F.col("known"), rule("error", "already_canonical")),
        F.when(F.col("kind") == "prompt", rule("warning", "duplicate_prompt")),
    ))
    return met.select("case_id", F.explode(rules).alias("r")).select("case_id", "r.severity", "r.rule", F.lit("").alias("detail"))


def audit(df: DataFrame, canonical: DataFrame | None = None, min_tags: int = 5, profiled: bool = False) -> DataFrame:
    """All findings: the record rules, ids repeated in the shard or already canonical, and repeated prompts."""
    return record_findings(df, min_tags, profiled).unionByName(_repeated(df, canonical))


# Wording of each finding behind its case id, with the detail in place of {} (fixed values).
MESSAGES = {
    "missing_field": "missing required field {}",
    "blank_element": "{} must be a non-empty string",
    "case_id_form": "case_id should be lowercase snake_case",
    "already_canonical": "duplicate case_id already in canonical dataset",
    "syntax_error": "completion syntax error: {}",
    "entry_scene_not_found": "entry_scene '{}' not found",
    "missing_snippet": "missing must_contain snippet '{}'",
    "forbidden_snippet": "contains forbidden snippet '{}'",
    "duplicate_id": "duplicate case_id in shard",
    "few_tags": "has only {} tags",
    "missing_staging_tag": "missing staging tag {}",
    "short_prompt": "prompt is short for a training sample",
    "missing_license": "missing license",
    "missing_import_line": "completion should use from manim import *",
    "scene_count": "expected one intended scene class, found [{}]",
    "duplicate_prompt": "duplicate prompt text",
}


def with_messages(findings: DataFrame) -> DataFrame:
    """Add ``message``, the finding as a line to print."""
    wording = F.create_map(*[F.lit(part) for pair in MESSAGES.items() for part in pair])
    return findings.withColumn(
        "message", F.concat(F.coalesce("case_id", F.lit("None")), F.lit(": "), F.replace(wording[F.col("rule")], F.lit("{}"), F.col("detail")))
    )


def audit_totals(findings: DataFrame) -> DataFrame:
    """Findings per severity and rule."""
    return findings.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n_findings"))


def passes(findings: DataFrame) -> bool:
    """The gate: no error among the findings."""
    return findings.filter(F.col("severity") == "error").isEmpty()


def element_counts(df: DataFrame, column: str, out: str = "element") -> DataFrame:
    """How often each element of a list column occurs."""
    return df.select(F.explode(column).alias(out)).filter(F.col(out).isNotNull()).groupBy(out).agg(F.count(F.lit(1)).alias("n_uses"))


def coverage_nodes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Cases per node of each axis; an axis is a column of one value or a list of values."""
    kinds = dict(df.dtypes)
    parts = []
    for axis in axes:
        value = F.explode(axis) if kinds[axis].startswith("array") else F.col(axis)
        parts.append(df.select(F.lit(axis).alias("axis"), value.alias("node")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.filter(F.col("node").isNotNull()).groupBy("axis", "node").agg(F.count(F.lit(1)).alias("n_cases"))


def coverage_gaps(df: DataFrame, first: str, second: str, second_nodes: Sequence[str]) -> DataFrame:
    """Node pairs no case covers: every node of the first axis against the scaffold's nodes of the second.

    The second axis is a configured list, exploded per distinct first node, so no join builds the pairs.
    """
    observed = df.select(F.col(first), F.col(second)).distinct()
    wanted = observed.select(first).distinct().filter(F.col(first).isNotNull()).select(
        first, F.explode(F.array(*[F.lit(n) for n in second_nodes])).alias(second)
    )
    return wanted.join(observed, [first, second], "left_anti")
