"""Case records, keys, the canonical dataset and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from corpuslab.functions import tags as tag_functions
from corpuslab.functions import text
from corpuslab.operators import canonical, cases, curation, keys, ordered, splitting
from corpuslab.sources import packages

INCLUDE, EXCLUDE = ("lang:en",), ("tier:silver", "source:src3")
SPEC = splitting.SplitSpec(0.75, 0.125, 42)

ORDERED = """
ordered_v AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || case_id)) AS pos, count(*) OVER () AS n FROM {source}),
split_v AS (SELECT *, CASE WHEN pos <= least(greatest(1, CAST(floor(n * 0.75) AS BIGINT)), n - 2) THEN 'train'
  WHEN pos <= least(greatest(1, CAST(floor(n * 0.75) AS BIGINT)), n - 2)
    + least(greatest(1, CAST(floor(n * 0.125) AS BIGINT)), n - least(greatest(1, CAST(floor(n * 0.75) AS BIGINT)), n - 2) - 1) THEN 'valid'
  ELSE 'test' END AS split FROM ordered_v)
"""
SPLIT = ORDERED.format(source="cases_v")
DURATION = """CASE WHEN target_duration_seconds IS NULL THEN NULL WHEN target_duration_seconds <= 6 THEN 'duration:5s'
  WHEN target_duration_seconds <= 12 THEN 'duration:10s' WHEN target_duration_seconds <= 22 THEN 'duration:20s'
  WHEN target_duration_seconds <= 40 THEN 'duration:30s' ELSE 'duration:50s' END"""


def _joined(column: str = "tags"):
    return F.array_join(column, "|").alias(column)


@query("normalize_chat", f"""WITH {views.TURNS}
SELECT case_id,
  coalesce(arg_min(content, turn) FILTER (role = 'system' AND content IS NOT NULL), '{cases.DEFAULT_SYSTEM_PROMPT}') AS system,
  arg_min(content, turn) FILTER (role = 'user' AND content IS NOT NULL) AS prompt,
  arg_min(content, turn) FILTER (role = 'assistant' AND content IS NOT NULL) AS completion,
  coalesce(trim(arg_min(content, turn) FILTER (role = 'assistant' AND content IS NOT NULL)), '') <> ''
    AND bool_or(role = 'user' AND content IS NOT NULL) AS usable
FROM turns_v GROUP BY case_id""")
def normalize_chat(spark, folder):
    normal = cases.normalise(cases.from_turns(views.turns(spark, folder), "case_id", "turn"))
    return normal.select("case_id", "system", "prompt", "completion", cases.is_usable().alias("usable"))


@query("tag_filter", f"""WITH {views.CASES}
SELECT case_id, array_to_string(tags, '|') AS tags FROM cases_v
WHERE list_contains(tags, 'lang:en') AND NOT list_has_any(tags, ['tier:silver', 'source:src3'])""")
def tag_filter(spark, folder):
    return cases.tag_filter(views.cases(spark, folder), INCLUDE, EXCLUDE).select("case_id", _joined())


@query("prepare_cases", f"""WITH {views.CASES}
SELECT case_id, '{cases.DEFAULT_SYSTEM_PROMPT}' AS system, prompt, completion, array_to_string(tags, '|') AS tags FROM cases_v
WHERE list_contains(tags, 'lang:de') AND trim(completion) <> ''""")
def prepare_cases(spark, folder):
    return cases.prepare(views.cases(spark, folder), include=("lang:de",)).select(
        "case_id", "system", "prompt", "completion", _joined()
    )


@query("chat_records", f"""WITH {views.CASES}
SELECT case_id, 'system' AS role_1, 'user' AS role_2, 'assistant' AS role_3,
  '{cases.DEFAULT_SYSTEM_PROMPT}' AS content_1, prompt AS content_2, completion AS content_3,
  license, source_name, CAST(NULL AS VARCHAR) AS source_url, target_duration_seconds FROM cases_v""")
def chat_records(spark, folder):
    chat = cases.chat_records(cases.normalise(views.cases(spark, folder)))
    parts = []
    for i in range(3):
        message = F.get("messages", F.lit(i))
        parts += [message["role"].alias(f"role_{i + 1}"), message["content"].alias(f"content_{i + 1}")]
    return chat.select("case_id", *parts, "license", "source_name", "source_url", "target_duration_seconds")


@query("license_gaps", f"WITH {views.CASES} SELECT case_id FROM cases_v WHERE license IS NULL OR trim(license) = ''")
def license_gaps(spark, folder):
    return cases.license_gaps(views.cases(spark, folder))


@query("license_gap_preview", f"""WITH {views.CASES}
SELECT case_id FROM cases_v WHERE license IS NULL OR trim(license) = '' ORDER BY case_id LIMIT 10""")
def license_gap_preview(spark, folder):
    return cases.license_gap_preview(views.cases(spark, folder))


@query("default_license", f"""WITH {views.CASES}
SELECT coalesce(license, 'MIT') AS license, count(*) AS n_cases FROM cases_v GROUP BY 1""")
def default_license(spark, folder):
    return cases.with_default_license(views.cases(spark, folder)).groupBy("license").agg(F.count(F.lit(1)).alias("n_cases"))


@query("duration_bucket", f"WITH {views.CASES} SELECT {DURATION} AS duration, count(*) AS n_cases FROM cases_v GROUP BY 1")
def duration_bucket(spark, folder):
    duration = tag_functions.duration_tag(F.col("target_duration_seconds")).alias("duration")
    return views.cases(spark, folder).groupBy(duration).agg(F.count(F.lit(1)).alias("n_cases"))


@query("tag_merge", f"""WITH {views.CASES}
SELECT case_id, array_to_string(list_concat(list_concat(tags, tags),
  list_filter(['tier:gold', 'source:docs', {DURATION}], lambda t: NOT list_contains(tags, t))), '|') AS tags FROM cases_v""")
def tag_merge(spark, folder):
    """Doubled tags show that repeats already there are kept."""
    doubled = views.cases(spark, folder).withColumn("tags", F.concat("tags", "tags"))
    merged = tag_functions.with_provenance(
        F.col("tags"), tag_functions.string_array(("tier:gold", "source:docs")), F.col("target_duration_seconds")
    )
    return doubled.select("case_id", F.array_join(merged, "|").alias("tags"))


@query("promote_tags", f"""WITH {views.CASES},
staged AS (SELECT case_id, list_concat(tags, ['review-candidate', 'tier:candidate', 'status:unreviewed']) AS tags FROM cases_v),
kept AS (SELECT case_id, list_filter(tags, lambda t: t NOT IN ('review-candidate', 'tier:candidate', 'status:unreviewed')) AS tags FROM staged)
SELECT case_id, array_to_string(list_concat(tags, list_filter(['tier:silver', 'status:approved', 'source:review-promotion'],
  lambda t: NOT list_contains(tags, t))), '|') AS tags FROM kept""")
def promote_tags(spark, folder):
    staged = views.cases(spark, folder).select(
        "case_id", F.concat("tags", tag_functions.string_array(tag_functions.STAGING_TAGS)).alias("tags")
    )
    return staged.select("case_id", F.array_join(tag_functions.promoted(F.col("tags")), "|").alias("tags"))


@query("head_cases", f"WITH {views.CASES} SELECT case_id, prompt FROM cases_v ORDER BY case_id LIMIT 21")
def head_cases(spark, folder):
    return ordered.row_slice(views.cases(spark, folder), ["case_id"], limit=21).select("case_id", "prompt")


@query("case_slice", f"WITH {views.CASES} SELECT case_id FROM cases_v ORDER BY case_id OFFSET 50")
def case_slice(spark, folder):
    """Everything from the 51st case on: too many rows for a top-k plan."""
    return ordered.row_slice(views.cases(spark, folder).select("case_id"), ["case_id"], offset=50)


@query("canonical_keep", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT case_id, license FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')""")
def canonical_keep(spark, folder):
    rejected = views.reviews(spark, folder).filter(F.col("decision") == "reject")
    return canonical.keep_unrejected(views.cases(spark, folder), rejected).select("case_id", "license")


@query("duplicate_keys", f"""WITH {views.RAW_RESULTS}
SELECT run_name, case_id, count(*) AS n_rows FROM raw_results_v GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, folder):
    return keys.duplicate_keys(views.raw_results(spark, folder), "run_name", "case_id")


@query("unknown_refs", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT DISTINCT case_id FROM reviews_v WHERE case_id NOT IN (SELECT case_id FROM cases_v WHERE list_contains(tags, 'lang:en'))""")
def unknown_refs(spark, folder):
    known = cases.tag_filter(views.cases(spark, folder), include=("lang:en",))
    return keys.unknown_refs(views.reviews(spark, folder), known)


@query("already_applied", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT DISTINCT case_id FROM reviews_v WHERE decision IN ('promote', 'reject')
  AND (case_id IN (SELECT case_id FROM cases_v WHERE list_contains(tags, 'lang:fr'))
    OR case_id IN (SELECT case_id FROM cases_v WHERE license = 'GPL-3.0'))""")
def already_applied(spark, folder):
    rows = views.cases(spark, folder)
    logged, archived = cases.tag_filter(rows, include=("lang:fr",)), rows.filter(F.col("license") == "GPL-3.0")
    return keys.already_present(curation.actionable(views.reviews(spark, folder)), logged, archived)


@query("exact_split", f"WITH {views.CASES}, {SPLIT} SELECT case_id, split FROM split_v")
def exact_split(spark, folder):
    return splitting.exact_split(views.cases(spark, folder), SPEC).select("case_id", "split")


@query("split_manifest", f"""WITH {views.CASES}, {SPLIT}
SELECT 'documents' AS source_dataset, CAST(42 AS BIGINT) AS split_seed, '' AS include_tags, '' AS exclude_tags,
  count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test
FROM split_v""")
def split_manifest(spark, folder):
    split = splitting.exact_split(views.cases(spark, folder), SPEC)
    return splitting.split_manifest(split, "documents", SPEC).select(
        "source_dataset", "split_seed", _joined("include_tags"), _joined("exclude_tags"), "train", "valid", "test"
    )


@query("export_chat_counts", f"""WITH {views.CASES}, {SPLIT}
SELECT CASE split WHEN 'valid' THEN 'validation' ELSE split END AS split, count(*) AS n_rows FROM split_v GROUP BY 1""")
def export_chat_counts(spark, folder):
    split = splitting.exact_split(cases.normalise(views.cases(spark, folder)), SPEC)
    return splitting.split_counts(packages.export_split_names(split))


@query("split_variant", f"""WITH {views.CASES}, {SPLIT}
SELECT case_id, split FROM split_v WHERE split = 'test' OR NOT list_has_any(tags, ['lang:es', 'tier:silver'])""")
def split_variant(spark, folder):
    split = splitting.exact_split(views.cases(spark, folder), SPEC)
    return splitting.split_variant(split, ("lang:es", "tier:silver")).select("case_id", "split")


@query("canonical_split", f"""WITH {views.CASES}, {views.REVIEWS},
kept_v AS (SELECT * FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')
  AND NOT list_contains(tags, 'source:src3')),
{ORDERED.format(source="kept_v")}
SELECT split, tags[1] AS lang, {DURATION} AS duration, count(*) AS n_cases FROM split_v GROUP BY ALL""")
def canonical_split(spark, folder):
    """Reject drop, provenance tags, tag filter, exact split and the counts of it all."""
    rejected = views.reviews(spark, folder).filter(F.col("decision") == "reject")
    kept = canonical.keep_unrejected(views.cases(spark, folder), rejected)
    tagged = canonical.with_curation_tags(kept.withColumn("_source", tag_functions.string_array(("tier:gold",))), "_source")
    split = splitting.exact_split(cases.tag_filter(tagged, exclude=("source:src3",)), SPEC)
    duration = F.get(F.filter("tags", lambda t: F.startswith(t, F.lit("duration:"))), F.lit(0))
    return split.groupBy("split", F.get("tags", F.lit(0)).alias("lang"), duration.alias("duration")).agg(
        F.count(F.lit(1)).alias("n_cases")
    )


@query("canonical_rebuild", f"""WITH {views.CASES}, {views.REVIEWS},
merged AS (
  SELECT case_id, tags, target_duration_seconds, ['tier:gold', 'source:local'] AS extra FROM cases_v WHERE list_contains(tags, 'lang:en')
  UNION ALL SELECT case_id, tags, target_duration_seconds, ['tier:gold', 'source:docs'] FROM cases_v WHERE list_contains(tags, 'lang:de')
  UNION ALL SELECT case_id, tags, target_duration_seconds, ['tier:silver', 'source:repo'] FROM cases_v
    WHERE NOT list_has_any(tags, ['lang:en', 'lang:de']))
SELECT case_id, array_to_string(list_concat(tags, list_filter(list_concat(extra, [{DURATION}]), lambda t: NOT list_contains(tags, t))), '|') AS tags
FROM merged WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')""")
def canonical_rebuild(spark, folder):
    rows = cases.with_default_license(views.cases(spark, folder))
    shards = [
        (cases.tag_filter(rows, include=("lang:en",)), ("tier:gold", "source:local")),
        (cases.tag_filter(rows, include=("lang:de",)), ("tier:gold", "source:docs")),
        (cases.tag_filter(rows, exclude=("lang:en", "lang:de")), ("tier:silver", "source:repo")),
    ]
    rejected = views.reviews(spark, folder).filter(F.col("decision") == "reject")
    return canonical.rebuild(shards, rejected).select("case_id", _joined())


@query("merge_shards", f"""WITH {views.CASES}, {views.HOLDOUT}
SELECT case_id, license FROM cases_v UNION ALL SELECT case_id, NULL FROM holdout_v""")
def merge_shards(spark, folder):
    benchmark = views.holdout(spark, folder).select("case_id", F.col("text").alias("completion"))
    return canonical.merge_shards([views.cases(spark, folder), benchmark]).select("case_id", "license")


@query("slugs", """SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'run') AS slug FROM pages""")
def slugs(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("extract_code", """
SELECT doc_id, trim(text, chr(10) || chr(13) || chr(9) || ' ') AS code FROM documents""")
def extract_code(spark, folder):
    """English texts have no fence; German ones stand in a fence with a language and before another, the rest in one that text follows."""
    response = (
        F.when(F.col("lang") == "en", F.col("text"))
        .when(F.col("lang") == "de", F.concat(F.lit("before\n```python\n"), "text", F.lit("\n```\n```\nlater\n```")))
        .otherwise(F.concat(F.lit("``` \n "), "text", F.lit(" \n\n```"), "text"))
    )
    return views.table(spark, folder, "documents").select("doc_id", text.extract_code(response).alias("code"))


@query("compose_prompt", f"""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN trim(text) || E'\\n\\n---\\n\\n' || '{text.SKILL_HEADER}' || E'\\n\\n' || trim(text)
  WHEN role = 'user' THEN '{text.SKILL_HEADER}' || E'\\n\\n' || trim(text) END AS system_prompt FROM conversations""")
def compose_prompt(spark, folder):
    """System turns have both parts, user turns only the skill, assistant turns neither."""
    rows = views.table(spark, folder, "conversations")
    base = F.when(F.col("role") == "system", F.col("text")).otherwise("  ")
    skill = F.when(F.col("role").isin("system", "user"), F.col("text"))
    return rows.select("conv_id", "turn", text.compose_system_prompt(base, skill).alias("system_prompt"))


@query("harden_prompt", f"""WITH {views.TURNS}
SELECT case_id, turn, rtrim(content, chr(10) || chr(13) || chr(9) || ' ') || '{text.HARDENING_SUFFIX.replace("'", "''")}' AS hardened FROM turns_v""")
def harden_prompt(spark, folder):
    """Every turn, null ones too, each hardened twice."""
    rows = views.turns(spark, folder)
    return rows.select("case_id", "turn", text.harden_prompt(text.harden_prompt(F.col("content"))).alias("hardened"))


@query("log_tail", "SELECT doc_id, right(text, 1500) AS tail FROM documents")
def log_tail(spark, folder):
    return views.table(spark, folder, "documents").select("doc_id", text.log_tail(F.col("text")).alias("tail"))


@query("message_text", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text) ELSE trim(text) || chr(10) || 'end' END AS content FROM conversations""")
def message_text(spark, folder):
    """User turns as JSON strings, the others as a list of text parts of every accepted shape."""
    listed = F.concat(
        F.lit("["), F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))),
        F.lit(',{"type":"image","url":"x"},{"type":"output","text":{"value":"end"}}, 7, "  "]'),
    )
    plain = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), '(?s)^\\{"t":(.*)\\}$', 1)
    body = F.when(F.col("role") == "user", plain).otherwise(listed)
    return views.table(spark, folder, "conversations").select("conv_id", "turn", text.message_text(body).alias("content"))
