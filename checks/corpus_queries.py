"""Text shards, budgets, tokens and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views
from checks.registry import query
from corpuslab.functions import tags
from corpuslab.operators import audit, corpus, packing
from corpuslab.sources import shards
from corpuslab.session import checkpointed

# The pre-token pattern for an engine without look-ahead: a mark set before the last space of a run
# stands for the look-ahead, and no class matches the mark.
_SPACE = "\\t\\n\\x0B\\x0C\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_TOKENS = (
    "''(?i:[sdmt]|ll|ve|re)|[^\\r\\n\\p{L}\\p{N}\\x01]?\\p{L}+|\\p{N}{1,2}"
    f"| ?[^{_SPACE}\\p{{L}}\\p{{N}}\\x01]+[\\r\\n]*|[{_SPACE}]*[\\r\\n]|[{_SPACE}]+"
)
_BREAKS = _SPACE.replace("\\n", "").replace("\\r", "")
PRETOKENS = f"""
marked AS (SELECT doc_id, regexp_replace(text, '([{_BREAKS}])([^{_SPACE}])', chr(1) || '\\1\\2', 'g') AS text FROM documents),
tokens_v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKENS}')) AS pretoken FROM marked)
"""


@query("pretoken_freq", f"WITH {PRETOKENS} SELECT pretoken, count(*) AS n_uses FROM tokens_v GROUP BY pretoken")
def pretoken_freq(spark, folder):
    return corpus.pretoken_counts(views.table(spark, folder, "documents").select("text"))


@query("token_bytes", f"""WITH {PRETOKENS}
SELECT DISTINCT pretoken AS token, octet_length(encode(pretoken)) AS n_bytes FROM tokens_v
UNION ALL SELECT t, 0 FROM (VALUES ('<|reserved_0|>'), ('<|reserved_1|>'), ('<|reserved_2|>'), ('<|reserved_3|>')) v(t)""")
def token_bytes(spark, folder):
    """The vocabulary is what the documents hold, and the special tokens beside it."""
    words = pretoken_freq(spark, folder).select(F.col("pretoken").alias("token"))
    special = spark.range(1).select(F.explode(views.strings(*corpus.SPECIAL_TOKENS)).alias("token"))
    return corpus.token_bytes(words.unionByName(special)).withColumn("n_bytes", F.col("n_bytes").cast("bigint"))


@query("bits_per_byte", """
WITH t AS (SELECT l_linenumber AS run_no, l_tax * 10 + 0.5 AS nats, CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS n_bytes FROM lineitem)
SELECT run_no, CAST(sum(n_bytes) AS BIGINT) AS total_bytes,
  round(sum(nats) FILTER (n_bytes > 0) / (ln(2.0::DOUBLE) * sum(n_bytes)), 9) AS bits_per_byte FROM t GROUP BY run_no""")
def bits_per_byte(spark, folder):
    losses = views.table(spark, folder, "lineitem").select(
        F.col("l_linenumber").alias("run_no"), (F.col("l_tax") * 10 + 0.5).alias("nats"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity").cast("int")).alias("n_bytes"),
    )
    return corpus.bits_per_byte(losses, ["run_no"]).select("run_no", "total_bytes", F.round("bits_per_byte", 9).alias("bits_per_byte"))


@query("char_budget", """
WITH t AS (SELECT doc_id, length(substr(text, 1, 10000)) AS n, (SELECT sum(length(substr(text, 1, 10000))) FROM documents) AS total FROM documents),
r AS (SELECT doc_id, n, total, sum(n) OVER (ORDER BY doc_id) - n AS before FROM t)
SELECT doc_id, CAST(n AS INTEGER) AS n_chars_taken FROM r WHERE before < CAST(floor(total * 0.6) AS BIGINT)""")
def char_budget(spark, folder):
    """A budget of three fifths of the table's own characters."""
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    total = docs.agg(F.sum(F.char_length(corpus.capped(F.col("text"), 10_000)))).first()[0]
    taken = corpus.char_budget(docs, "doc_id", budget=int(total * 0.6), cap=10_000)
    return taken.select("doc_id", F.char_length("text").alias("n_chars_taken"))


@query("shard_split", """
SELECT 'documents.parquet' AS shard, 'train' AS split, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT 'conversations.parquet', 'train', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations
UNION ALL SELECT 'benchmark.parquet', 'val', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark""")
def shard_split(spark, folder):
    """The three tables with a text column as shards, one of them pinned for validation."""
    paths = [f"{folder}/{name}.parquet" for name in ("documents", "conversations", "benchmark")]
    rows = shards.read_shards(spark, paths, "benchmark.parquet")
    return rows.groupBy("shard", "split").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.char_length("text")).alias("n_chars")
    )


def _token_rows(spark, folder):
    docs = views.table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", corpus.hashed_token_ids(F.col("text"), 8192).alias("token_ids"))


@query("pack_sequences", f"""WITH {PRETOKENS}, t AS (SELECT doc_id, count(*) AS n, sum(length(pretoken)) AS total FROM tokens_v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_tokens, CAST(coalesce(total, 0) AS BIGINT) AS id_total, TRUE AS gapless, TRUE AS rows_right
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def pack_sequences(spark, folder):
    """Every token of every document stands in one place of one row: read back from the rows by their places.

    A pre-token's length is its id here, so a document's ids add up to the length of its text.
    """
    docs = views.table(spark, folder, "documents").select("doc_id", F.transform(corpus.pretokens(F.col("text")), lambda t: F.char_length(t)).alias("token_ids"))
    placements = checkpointed(packing.place_sequences(docs, "doc_id", "token_ids", 2048))
    rows = packing.placed_rows(placements, docs, "doc_id", "token_ids", -1)
    own = F.slice("tokens", F.col("at") + 2, (F.col("end") - F.col("begin")).cast("int"))
    read = placements.join(rows, ["part", "row_no"]).select(
        F.col("doc_key").alias("doc_id"), "begin", "end", F.size(own).alias("n"), F.aggregate(own, F.lit(0).cast("bigint"), lambda total, x: total + x).alias("total"),
        ((F.get("tokens", F.col("at")) == -1) & (F.get("tokens", F.lit(0)) == -1) & (F.size("tokens") <= 2049)).alias("right"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("begin", "end")))
    found = read.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("total").alias("id_total"), pieces.alias("pieces"), F.every("right").alias("rows_right"))
    follows = F.forall(F.sequence(F.lit(0), F.size("pieces") - 1), lambda k: F.get("pieces", k)["begin"] == F.when(k == 0, 0).otherwise(F.get("pieces", k - 1)["end"]))
    return found.select("doc_id", "n_tokens", "id_total", follows.alias("gapless"), "rows_right")


@query("packing_balance", f"""WITH {PRETOKENS}
SELECT count(*) + (SELECT count(*) FROM documents) AS tokens_in, (SELECT count(*) FROM documents) AS n_docs, TRUE AS rows_start_right FROM tokens_v""")
def packing_balance(spark, folder):
    """Tokens placed and cropped add up to the tokens that went in, a start token per document included."""
    packed = packing.pack_sequences(_token_rows(spark, folder), "doc_id", "token_ids", 2048, 8188)
    return packed.agg(
        (F.sum(F.size("tokens")) + F.sum("n_cropped")).alias("tokens_in"), F.sum("n_docs").alias("n_docs"),
        F.every(F.get("tokens", F.lit(0)) == 8188).alias("rows_start_right"),
    )


@query("tag_counts", f"""WITH {views.CASES}
SELECT 'tags' AS field, element, count(*) AS n_uses FROM (SELECT unnest(tags) AS element FROM cases_v) GROUP BY element
UNION ALL SELECT 'must_contain', element, count(*) FROM (SELECT unnest(must_contain) AS element FROM cases_v) GROUP BY element""")
def tag_counts(spark, folder):
    rows = views.cases(spark, folder)
    field = lambda name: F.lit(name).alias("field")
    return audit.element_counts(rows, "tags").select(field("tags"), "*").unionByName(
        audit.element_counts(rows, "must_contain").select(field("must_contain"), "*")
    )


@query("duplicate_prompts", f"""WITH {views.CASES},
n AS (SELECT case_id, regexp_replace(lower(trim(prompt, chr(10) || chr(13) || chr(9) || ' ')), '[ \\t\\r\\n]+', ' ', 'g') AS form FROM cases_v),
d AS (SELECT form FROM n WHERE form <> '' GROUP BY form HAVING count(*) > 1)
SELECT case_id, sha256(form) AS prompt_hash FROM n WHERE form IN (SELECT form FROM d)""")
def duplicate_prompts(spark, folder):
    return audit.duplicate_prompt_rows(views.cases(spark, folder).select("case_id", "prompt"))[["case_id", "prompt_hash"]]


@query("coverage_nodes", f"""WITH {views.CASES}
SELECT 'tags' AS axis, node, count(*) AS n_cases FROM (SELECT unnest(tags) AS node FROM cases_v) GROUP BY node
UNION ALL SELECT 'license', license, count(*) FROM cases_v WHERE license IS NOT NULL GROUP BY license
UNION ALL SELECT 'source_domain', source_domain, count(*) FROM cases_v GROUP BY source_domain""")
def coverage_nodes(spark, folder):
    return audit.coverage_nodes(views.cases(spark, folder), ("tags", "license", "source_domain"))


@query("coverage_gaps", """
WITH p AS (SELECT DISTINCT source, lang || ':' || CASE WHEN n_chars // 250 <= 6 THEN 'duration:5s' WHEN n_chars // 250 <= 12 THEN 'duration:10s'
  WHEN n_chars // 250 <= 22 THEN 'duration:20s' WHEN n_chars // 250 <= 40 THEN 'duration:30s' ELSE 'duration:50s' END AS node FROM documents),
w AS (SELECT s.source, l || ':' || d AS node FROM (SELECT DISTINCT source FROM documents) s,
  (VALUES ('en'), ('de'), ('fr'), ('es')) a(l), (VALUES ('duration:5s'), ('duration:10s'), ('duration:20s'), ('duration:30s'), ('duration:50s')) b(d))
SELECT source, node FROM w EXCEPT SELECT source, node FROM p""")
def coverage_gaps(spark, folder):
    nodes = [f"{lang}:{duration}" for lang in ("en", "de", "fr", "es") for duration in (*[d for _, d in tags.DURATION_CLASSES], tags.LONGEST_DURATION)]
    docs = views.table(spark, folder, "documents").select(
        "source", F.concat_ws(":", "lang", tags.duration_tag(F.floor(F.col("n_chars") / 250))).alias("node")
    )
    return audit.coverage_gaps(docs, "source", "node", nodes)
