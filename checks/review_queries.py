"""Review sessions, ratings and what is done with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from corpuslab.operators import curation, review

PAIR_COLUMNS = ("scene_name", "syntax_ok", "render_ok", "weighted_score", "prompt")
LEFT_FIRST = "CAST('0x' || substr(sha256('42:' || {key}), 1, 1) AS INTEGER) % 2 = 0"
SLUG = "coalesce(nullif(trim(regexp_replace(lower({key}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'run')"
SESSION = views.RESULTS + f""",
paired_v AS (
  SELECT l.case_id, l.scene_name AS ls, r.scene_name AS rs, coalesce(l.render_ok, FALSE) AS lr, coalesce(r.render_ok, FALSE) AS rr,
    l.weighted_score AS lw, r.weighted_score AS rw,
    CASE WHEN CAST(substr(l.case_id, 2) AS BIGINT) % 2 = 0 THEN 'left ' || l.case_id ELSE 'right ' || l.case_id END AS prompt
  FROM results_v l JOIN results_v r ON l.case_id = r.case_id WHERE l.run_name = 'line1' AND r.run_name = 'line2'),
session_v AS (SELECT *, {SLUG.format(key='case_id')} AS review_id, {LEFT_FIRST.format(key='case_id')} AS left_first FROM paired_v),
ratings_v AS (SELECT review_id, case_id, left_first, lr, rr, list_element(['A', 'B', 'both_good', 'skip'], CAST(CAST(substr(case_id, 2) AS BIGINT) % 4 AS INTEGER) + 1) AS verdict
  FROM session_v WHERE lr AND rr)
"""


def run_of(spark, folder, name, even):
    """A run's results; half its cases have no prompt of their own."""
    scored = views.results(spark, folder).filter(F.col("run_name") == name)
    has_prompt = (F.substring("case_id", 2, 30).cast("bigint") % 2 == 0) == F.lit(even)
    side = "left " if even else "right "
    return scored.withColumn("prompt", F.when(has_prompt, F.concat(F.lit(side), "case_id")).otherwise(""))


def pairs(spark, folder):
    return review.paired_runs(run_of(spark, folder, "line1", True), run_of(spark, folder, "line2", False), PAIR_COLUMNS)


def session(spark, folder):
    return review.blind_session(review.prompt_backfill(pairs(spark, folder)), "one", "two")


def ratings(spark, folder):
    """A made verdict for each session item."""
    number = F.substring("case_id", 2, 30).cast("bigint") % 4
    verdict = F.get(views.strings("A", "B", "both_good", "skip"), number.cast("int"))
    items = review.session_items(session(spark, folder))
    return items, items.select("review_id", verdict.alias("verdict"), F.lit("high").alias("confidence"), F.lit(" n ").alias("notes"))


@query("paired_runs", f"WITH {SESSION} SELECT case_id, ls AS left_scene_name, rs AS right_scene_name FROM session_v")
def paired_runs(spark, folder):
    return pairs(spark, folder).select("case_id", "left_scene_name", "right_scene_name")


@query("prompt_backfill", f"""WITH {views.RESULTS}
SELECT l.case_id, CASE CAST(substr(l.case_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'left ' || l.case_id WHEN 2 THEN 'left ' || l.case_id
  ELSE coalesce(CASE WHEN CAST(substr(l.case_id, 2) AS BIGINT) % 3 = 0 THEN 'split ' || l.case_id END, '') END AS prompt
FROM results_v l JOIN results_v r ON l.case_id = r.case_id WHERE l.run_name = 'line1' AND r.run_name = 'line2'""")
def prompt_backfill(spark, folder):
    """Odd cases have no prompt on either side; the split knows every third case."""
    left, right = run_of(spark, folder, "line1", True), run_of(spark, folder, "line2", False).withColumn("prompt", F.lit(None).cast("string"))
    split = views.results(spark, folder).select("case_id").distinct().filter(
        F.substring("case_id", 2, 30).cast("bigint") % 3 == 0
    ).withColumn("prompt", F.concat(F.lit("split "), "case_id"))
    return review.prompt_backfill(review.paired_runs(left, right, PAIR_COLUMNS), split).select("case_id", "prompt")


@query("blind_order", f"WITH {views.CASES} SELECT case_id, {LEFT_FIRST.format(key='case_id')} AS left_first FROM cases_v")
def blind_order(spark, folder):
    return views.cases(spark, folder).select("case_id", review.left_goes_first(F.col("case_id")).alias("left_first"))


@query("blind_session", f"""WITH {SESSION}
SELECT review_id, case_id, prompt, CASE WHEN left_first THEN 'one' ELSE 'two' END AS label_a, CASE WHEN left_first THEN 'two' ELSE 'one' END AS label_b,
  CASE WHEN left_first THEN ls ELSE rs END AS scene_a, round(CASE WHEN left_first THEN rw ELSE lw END, 9) AS score_b,
  CASE WHEN NOT (lr AND rr) THEN 'one_or_more_renders_failed' END AS skip_reason FROM session_v""")
def blind_session(spark, folder):
    field = lambda slot, name: review.slot_field(F.col("options"), slot, name)
    return session(spark, folder).select(
        "review_id", "case_id", "prompt", field("A", "label").alias("label_a"), field("B", "label").alias("label_b"),
        field("A", "scene_name").alias("scene_a"), F.round(field("B", "weighted_score"), 9).alias("score_b"), "skip_reason",
    )


@query("unblinded_ratings", f"""WITH {SESSION}
SELECT review_id, verdict, 'n' AS notes, CASE WHEN verdict = 'A' THEN CASE WHEN left_first THEN 'one' ELSE 'two' END
  WHEN verdict = 'B' THEN CASE WHEN left_first THEN 'two' ELSE 'one' END END AS preferred_label,
  CASE WHEN verdict IN ('A', 'B') THEN verdict END AS preferred_slot FROM ratings_v""")
def unblinded_ratings(spark, folder):
    items, rated = ratings(spark, folder)
    return review.rating_records(items, rated).select("review_id", "verdict", "notes", "preferred_label", "preferred_slot")


@query("preference_wins", f"""WITH {SESSION},
labelled AS (SELECT CASE WHEN verdict = 'A' THEN CASE WHEN left_first THEN 'one' ELSE 'two' END
  WHEN verdict = 'B' THEN CASE WHEN left_first THEN 'two' ELSE 'one' END END AS preferred FROM ratings_v)
SELECT label, count(*) AS n_shown, count(*) FILTER (preferred = label) AS n_wins, count(*) FILTER (preferred IS NULL) AS n_undecided
FROM labelled, (VALUES ('one'), ('two')) t(label) GROUP BY label""")
def preference_wins(spark, folder):
    items, rated = ratings(spark, folder)
    return review.preference_wins(review.rating_records(items, rated))


@query("public_items", f"""WITH {SESSION}
SELECT review_id, case_id, verdict <> 'skip' AS rated,
  (CASE WHEN left_first THEN 'line1' ELSE 'line2' END) IS NOT NULL AS has_options FROM ratings_v""")
def public_items(spark, folder):
    items, rated = ratings(spark, folder)
    shown = review.public_items(items, rated.filter(F.col("verdict") != "skip"))
    return shown.select("review_id", "case_id", "rated", (F.size("options") == 2).alias("has_options"))


@query("session_progress", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT (SELECT count(*) FROM cases_v) AS total, (SELECT count(DISTINCT case_id) FROM reviews_v) AS rated,
  greatest((SELECT count(*) FROM cases_v) - (SELECT count(DISTINCT case_id) FROM reviews_v), 0) AS remaining""")
def session_progress(spark, folder):
    items = views.cases(spark, folder).select(F.col("case_id").alias("review_id"))
    return review.session_progress(items, views.reviews(spark, folder).select(F.col("case_id").alias("review_id")))


@query("review_batch", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT case_id, array_to_string(tags, '|') AS tags FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v)
ORDER BY case_id OFFSET 20 LIMIT 50""")
def review_batch(spark, folder):
    decided = views.reviews(spark, folder)
    rated = [decided.filter(F.col("decision") != "skip"), decided.filter(F.col("decision") == "skip")]
    batch = review.review_batch(views.cases(spark, folder).select("case_id", "tags"), rated, offset=20, limit=50)
    return batch.select("case_id", F.array_join("tags", "|").alias("tags"))


@query("approved_ids", """
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS case_id FROM labels WHERE quality = 1 AND toxic = 0 OR quality = 0 AND toxic = 1""")
def approved_ids(spark, folder):
    """Approvals in different fields and spellings; an empty decision gives way to the next field."""
    labels = views.table(spark, folder, "labels")
    rated = labels.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("case_id"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), " Approved ").otherwise("").alias("decision"),
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "KEEP\n").when(F.col("quality") == 0, "bad").alias("label"),
        F.lit("skip").alias("verdict"),
    )
    return curation.approved_ids(rated)


@query("apply_decisions", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT 'dataset' AS part, case_id, NULL AS decision FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')
UNION ALL SELECT 'log', case_id, decision FROM reviews_v WHERE decision IN ('promote', 'reject')
UNION ALL SELECT 'archive', case_id, NULL FROM cases_v WHERE case_id IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')""")
def apply_decisions(spark, folder):
    applied = curation.apply_decisions(views.cases(spark, folder), views.reviews(spark, folder), review_path="labels")
    none = F.lit(None).cast("string").alias("decision")
    return (
        applied.dataset.select(F.lit("dataset").alias("part"), "case_id", none)
        .unionByName(applied.log_entries.select(F.lit("log").alias("part"), "case_id", "decision"))
        .unionByName(applied.archived.select(F.lit("archive").alias("part"), "case_id", none))
    )


@query("promote_batch", f"""WITH {views.CASES}, {views.REVIEWS},
ok AS (SELECT case_id FROM reviews_v WHERE decision = 'promote')
SELECT 'promoted' AS part, case_id, coalesce(license, 'MIT') AS license, array_to_string(list_concat(tags, list_filter(
  ['tier:silver', 'status:approved', 'source:review-promotion'], lambda t: NOT list_contains(tags, t))), '|') AS tags
FROM cases_v WHERE case_id IN (SELECT case_id FROM ok)
UNION ALL SELECT 'remaining', case_id, license, array_to_string(tags, '|') FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM ok)""")
def promote_batch(spark, folder):
    result = curation.promote(views.cases(spark, folder), views.reviews(spark, folder))
    def part(rows, name):
        return rows.select(F.lit(name).alias("part"), "case_id", "license", F.array_join("tags", "|").alias("tags"))

    return part(result.promoted, "promoted").unionByName(part(result.remaining, "remaining"))


@query("review_summary", f"""WITH {views.CASES}, {views.REVIEWS}
SELECT count(*) FILTER (decision IN ('promote', 'reject')) AS num_decisions_applied, count(*) FILTER (decision = 'promote') AS num_promoted,
  count(*) FILTER (decision = 'reject') AS num_rejected,
  (SELECT count(*) FROM cases_v WHERE case_id NOT IN (SELECT case_id FROM reviews_v WHERE decision = 'reject')) AS num_remaining_dataset_cases
FROM reviews_v""")
def review_summary(spark, folder):
    return curation.review_summary(views.reviews(spark, folder), views.cases(spark, folder))


@query("render_summary", f"""WITH {views.RESULTS}
SELECT count(*) AS num_cases, count(*) FILTER (render_ok) AS num_rendered FROM results_v""")
def render_summary(spark, folder):
    return curation.render_summary(views.results(spark, folder))


@query("candidate_partition", """
SELECT CASE WHEN quality = 1 THEN 'plain' ELSE 'custom' END AS candidate_set, count(*) AS n_cases
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def candidate_partition(spark, folder):
    """Documents without a label have an unknown flag."""
    labels = views.table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("is_plain_manim_candidate"))
    rows = views.table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return curation.candidate_flag(rows).groupBy("candidate_set").agg(F.count(F.lit(1)).alias("n_cases"))


@query("source_counts", """
SELECT source AS source_name, lang AS source_ref, count(*) AS case_count FROM documents GROUP BY GROUPING SETS ((source, lang), ())""")
def source_counts(spark, folder):
    rows = views.table(spark, folder, "documents").select(F.col("source").alias("source_name"), F.col("lang").alias("source_ref"))
    return curation.source_counts(rows)


@query("sample_session", f"""WITH {views.CASES}
SELECT {SLUG.format(key='case_id')} AS review_id, case_id, array_to_string(tags, '|') AS tags, 'sample' AS label, target_duration_seconds < 20 AS render_ok FROM cases_v""")
def sample_session(spark, folder):
    rows = views.cases(spark, folder).withColumns({
        "render_ok": F.col("target_duration_seconds") < 20, "render_log_tail": F.lit(""),
    })
    option = F.get("options", F.lit(0))
    return review.sample_session(rows).select(
        "review_id", "case_id", F.array_join("tags", "|").alias("tags"), option["label"].alias("label"), option["render_ok"].alias("render_ok")
    )
