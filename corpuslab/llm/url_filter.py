"""URL filters: listed rules first, then gradient-boosted trees on lexical features.

A rule is a host and the start of a path, written together; it fits the host and its subdomains where the url's path
starts with the rule's, and the longest fitting rule decides. URLs that a rule decides are the labelled ones: on a
bounded sample of them trees are boosted on length, depth, digit ratio, entropy, parameter counts and statistics of
the host's last label, and judge the rest.

Results by definition: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A to Z in
lower case; the path follows up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and
path. Of fitting rules of one length, block wins. If the rules decide nothing, all else is allowed; if they decide
all one way, all else is judged that way. Every suffix of the table has its own statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common
from corpuslab.session import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The sample is trained on in so many partitions: it is small.
PARTS = 4
FEATURES = (
    "_length", "_host_length", "_path_length", "_labels", "_depth", "_digits", "_letters", "_entropy", "_params",
    "_ampersands", "_hyphens", "_fragment", "_secure", "_dotted_file", "_suffix_blocked", "_suffix_share",
)


@dataclass(frozen=True)
class Settings:
    """At most ``rows`` labelled urls of each verdict are learned from."""

    rows: int = 10_000
    trees: int = 15
    depth: int = 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _entropy(text: Column) -> Column:
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((size - F.length(F.replace(text, c, F.lit("")))) / size))
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def described(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and the lexical features, but for the suffix statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({
        "_suffix": F.substring_index("host", ".", -1),
        "_length": F.length(url).cast("double"),
        "_host_length": F.length("host").cast("double"),
        "_path_length": F.length("path").cast("double"),
        "_labels": _count(F.col("host"), ".").cast("double"),
        "_depth": _count(F.col("path"), "/").cast("double"),
        "_digits": 1 - _share(url, "[0-9]"),
        "_letters": 1 - _share(url, "[A-Za-z]"),
        "_entropy": _entropy(url),
        "_params": _count(query, "=").cast("double"),
        "_ampersands": _count(query, "&").cast("double"),
        "_hyphens": _count(url, "-").cast("double"),
        "_fragment": F.contains(url, F.lit("#")).cast("double"),
        "_secure": F.startswith(url, F.lit("https")).cast("double"),
        "_dotted_file": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    })


def judge(pages: DataFrame, rules: list[tuple[str, str]], settings: Settings = Settings()) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the trees' probability of block (columns of these names are replaced)."""
    facts = described(common.wrapped(pages, "url", without=("host", "path", "rule", "verdict", "p_block")))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    facts = facts.withColumns({"rule": rule, "_ruled": verdict})
    # Statistics of suffixes over all urls, counted on the map side first.
    counts = facts.groupBy("_suffix").agg(
        F.count("*").alias("n"), F.coalesce(F.sum((F.col("_ruled") == "block").cast("long")), F.lit(0)).alias("blocked"), F.count("_ruled").alias("ruled")
    )
    counts = checkpointed(counts)
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "blocked", "ruled")]).first()
    ruled_rows, blocked = total["ruled"], total["blocked"]
    if not 0 < blocked < ruled_rows:
        constant = "block" if blocked else "allow"
        return facts.select("_user.*", "host", "path", "rule", F.coalesce("_ruled", F.lit(constant)).alias("verdict"), F.lit(float(bool(blocked))).alias("p_block"))
    prior = blocked / ruled_rows
    stats = counts.select(
        "_suffix", F.col("n").alias("_n"),
        ((F.col("blocked") + F.lit(prior)) / (F.col("ruled") + 1)).alias("_suffix_blocked"), (F.col("n") / F.lit(total["n"])).alias("_suffix_share"),
    )
    facts = common.join_skewed(facts, stats, "_suffix", "_n", total["n"])
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    labelled = facts.where(F.col("_ruled").isNotNull()).withColumn("_key", F.xxhash64("url")).select("_key", "_ruled", *FEATURES)
    sample = common.bounded_sample(labelled, F.col("_ruled"), "_key", F.lit(1), settings.rows, settings.rows)
    train = checkpointed(assembler.transform(sample).select("_x", (F.col("_ruled") == "block").cast("double").alias("_y")).coalesce(PARTS))
    model = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_best", maxIter=settings.trees, maxDepth=settings.depth, seed=1)
    model = model.setProbabilityCol("_prob").setRawPredictionCol("_raw").fit(train)
    scored = model.transform(assembler.transform(facts)).withColumn("p_block", vector_to_array("_prob")[1])
    judged = F.coalesce("_ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("_user.*", "host", "path", "rule", judged.alias("verdict"), "p_block")
