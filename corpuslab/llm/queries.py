"""Queries of this package over the given tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import common, decontamination, exact_dedup, html_extract, language_id, lexical_search, line_dedup, mixing, near_dedup, periodic_runs, secrets, sequence_packing, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    model = language_id.learn(docs.where(~common.held_out(F.col("doc_id"))))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"),
    )


@query
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(common.table(spark, folder, "documents"))


SQL["op3_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM n WINDOW g AS (PARTITION BY body)
"""


@query
def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.find_classes(common.table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    rows, domains = mixing.mixed(docs, labels, carry=["doc_id", "source"])
    shares = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(domains)]
    return rows.select("doc_id", "source", "tokens", *shares, "rate", "copies")


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    known = ~common.held_out(F.col("doc_id"))
    model = toxicity.learn(docs.where(known), labels.where(known))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity.score").alias("score"),
        (F.col("_toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("_toxicity.spans").alias("spans"),
    )


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.learn(docs)).select("doc_id", "_secrets.*")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.learn(pages))
    return found.select("page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("long").alias("n_chars"))


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.remove_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
starts AS (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM l),
w AS (
  SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS body FROM starts
),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS turn
  FROM w WHERE body <> chr(10) || chr(10)
),
gone AS (SELECT DISTINCT doc_id, pos + k AS i FROM ranked, (SELECT unnest([0, 1, 2]) AS k) s WHERE turn > 1),
each AS (SELECT doc_id, unnest(range(0, len(lines))) AS i, unnest(lines) AS line FROM l),
kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS body FROM each e
  LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id
),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, len(l.lines) AS n_lines, coalesce(lost.n, 0) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.body, '') END AS text
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id LEFT JOIN lost ON l.doc_id = lost.doc_id
"""


TOKENIZER = "word_bpe_49k.json"


@query
def op11_sequence_packing(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        tokenizer = file.read()
    return sequence_packing.pack(common.table(spark, folder, "documents").select("doc_id", "text"), tokenizer)


@query
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


SQL["op12_lexical_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL
),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
norms AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM sizes, totals),
wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
),
asked AS (SELECT item_id, term, count(*) AS times FROM wanted GROUP BY item_id, term),
weighted AS (
  SELECT item_id, asked.term, times, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM asked JOIN dfs ON asked.term = dfs.term, totals
),
scored AS (
  SELECT item_id, tfs.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM weighted JOIN tfs ON weighted.term = tfs.term JOIN norms ON tfs.doc_id = norms.doc_id GROUP BY item_id, tfs.doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text")))
    facts = found.select("doc_id", "_runs.*").withColumn("best", periodic_runs.longest(F.col("runs")))
    return facts.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.as_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
