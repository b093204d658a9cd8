"""Mixing to target weights with soft membership: document rates whose expected domain token totals match targets.

Domains are the classes of the labelled table, quality and toxicity together. A multinomial logistic regression,
fitted on a bounded sample of labelled documents, gives every document a posterior over domains from plain facts of
its text (share of separators, word length, distinct words and lines, length, words of a learned list). A document's
tokens count for each domain in proportion to the posterior.

Rates r >= 0 minimise the squared distance of the expected domain totals from the targets plus ``pull`` times the
token-weighted squared distance of the rates from 1. Projected gradient steps start at rate 1: the gradient of a row is
posterior . residual + pull * (rate - 1), with the residual per token; rows that are free (rate above 0, or a gradient
that points inward) step along it, in the metric of the free rows' second derivatives, and every new rate is projected
to 0 or more. The narrow table holds the rates. A step takes two aggregations: sums of the free rows' posteriors, and
the objective at a few step lengths, of which the longest that makes it less is taken. At the minimum a rate is
max(0, 1 - posterior . residual / pull), which gives the rates of the wide rows without a join.

Results by definition: every row is returned once, with tokens, posterior (in the order of ``domains``), rate and
copies (the rate rounded up or down by a hash of the id). Null and empty texts have no tokens and the posterior of an
empty text. Without labels there is one domain, ``all``. Targets of domains that were not learned, and domains
without a token, are left out and the other weights scaled; ids may repeat or be null (such rows share a draw).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslab.llm import common
from corpuslab.session import checkpointed, released, scratch_path

OUTPUT = ("tokens", "posterior", "rate", "copies")
# Step lengths that are tried at once, and steps after which the narrow table is written anew.
LENGTHS = (1.0, 0.5, 0.25, 0.0625)
WRITTEN = 6
FEATURES = ("_separators", "_word_length", "_distinct_words", "_distinct_lines", "_log_words")


@dataclass(frozen=True)
class Settings:
    """``targets`` maps a domain (quality and toxicity, as q1t0) to its share of ``scale`` times all tokens."""

    targets: dict[str, float] = field(default_factory=lambda: {"q1t0": 0.9, "q0t0": 0.07, "q1t1": 0.02, "q0t1": 0.01})
    scale: float = 1.0
    pull: float = 1e-3
    rows: int = 4000
    bytes: int = 20_000_000
    words: int = 100
    least: int = 5
    steps: int = 25
    tolerance: float = 1e-6


def _tokens() -> Column:
    return F.filter(F.split(F.lower(common.text_of()), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def described(rows: DataFrame, listed: list[list[str]]) -> DataFrame:
    """``rows`` with ``_tokens`` (how many words), the columns FEATURES and, for each list of words, ``_hits<n>`` and ``_any<n>``."""
    size = F.greatest(F.size("_words"), F.lit(1))
    lines = F.split(common.text_of(), "\n")
    facts = {
        "_tokens": F.size("_words").cast("long"),
        "_separators": 1 - F.length(F.array_join("_words", "")) / F.greatest(F.length(common.text_of()), F.lit(1)),
        "_word_length": F.length(F.array_join("_words", "")) / size,
        "_distinct_words": F.size(F.array_distinct("_words")) / size,
        "_distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "_log_words": F.log1p(F.size("_words").cast("double")),
    }
    counted = rows.withColumn("_words", _tokens())
    for n, words in enumerate(listed):
        hits = F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
        facts |= {f"_hits{n}": F.log1p(hits.cast("double")), f"_any{n}": (hits > 0).cast("double")}
    return counted.withColumns(facts).drop("_words")


def _listed_words(sample: DataFrame, domains: list[str], settings: Settings) -> list[list[str]]:
    """For each domain the words that its documents hold far more often than its share of documents would have it."""
    seen = sample.select("_domain", F.explode(F.array_distinct(_tokens())).alias("word"))
    counts = seen.groupBy("word", "_domain").agg(F.count("*").alias("n"))
    shares = {r["_domain"]: r["n"] for r in sample.groupBy("_domain").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for d, n in shares.items():
        share = F.when(F.col("_domain") == d, F.lit(n / sum(shares.values()))).otherwise(share)
    by_word = counts.withColumn("expected", F.sum("n").over(Window.partitionBy("word")) * share)
    over = by_word.where((F.col("n") >= settings.least) & (F.col("n") > 2 * F.col("expected")))
    surprise = F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")
    rank = F.row_number().over(Window.partitionBy("_domain").orderBy(F.desc("_surprise"), "word"))
    best = over.withColumn("_surprise", surprise).withColumn("_rank", rank).where(F.col("_rank") <= settings.words).select("_domain", "word").collect()
    return [sorted(r["word"] for r in best if r["_domain"] == d) for d in domains]


def posteriors(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``_tokens``, ``_p`` and the text facts, and the domains in the order of ``_p``."""
    domain = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    marked = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", domain.alias("_domain")).dropDuplicates(["doc_id"])
    marked = common.bounded_sample(marked, F.col("_domain"), "doc_id", F.lit(1), settings.rows, settings.rows)
    # At most ``rows`` ids of each domain.
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    sample = checkpointed(common.bounded_sample(known, F.col("_domain"), "doc_id", F.octet_length(common.text_of()), settings.rows, settings.bytes))
    domains = sorted(r["_domain"] for r in sample.select("_domain").distinct().collect())
    if len(domains) < 2:
        plain = docs.withColumn("_tokens", F.size(_tokens()).cast("long"))
        return plain.withColumn("_p", F.array(F.lit(1.0))), domains or ["all"]
    listed = _listed_words(sample, domains, settings)
    columns = [*FEATURES, *(f"_{kind}{n}" for n in range(len(domains)) for kind in ("hits", "any"))]
    assembler = VectorAssembler(inputCols=columns, outputCol="_x")
    place = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")).cast("double") - 1
    train = checkpointed(assembler.transform(described(sample, listed)).select("_x", place.alias("_y")))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_prob", predictionCol="_best", rawPredictionCol="_raw", family="multinomial", regParam=1e-4, maxIter=50).fit(train)
    scored = model.transform(assembler.transform(described(docs, listed)))
    return scored.withColumn("_p", vector_to_array("_prob")), domains


def _dot(vector: np.ndarray) -> Column:
    total = F.lit(0.0)
    for k, v in enumerate(vector):
        total = total + F.col("_p")[k] * F.lit(float(v))
    return total


def _rate(m: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - _dot(m))


@dataclass
class Fit:
    """``m`` gives the rates, max(0, 1 - posterior . m); ``residual`` is what the totals of ``targets`` miss, both per token."""

    m: np.ndarray
    targets: np.ndarray
    residual: np.ndarray
    steps: int


def fit(facts: DataFrame, domains: list[str], settings: Settings) -> Fit:
    """Rates of ``facts`` (``_tokens``, ``_p``), from sums over its rows."""
    k, pull = len(domains), settings.pull
    t = F.col("_tokens").cast("double")

    def sums(rows: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([float(x or 0.0) for x in rows.agg(*[F.sum(c).alias(f"s{n}") for n, c in enumerate(columns)]).first()])

    totals = sums(facts, [t * F.col("_p")[i] for i in range(k)])
    tokens = totals.sum()
    weights = np.array([settings.targets.get(d, 0.0) if totals[i] > 0 else 0.0 for i, d in enumerate(domains)])
    if tokens <= 0 or not weights.sum():
        return Fit(np.zeros(k), np.zeros(k), np.zeros(k), 0)
    targets = weights / weights.sum() * settings.scale
    residual, value = totals / tokens - targets, None
    rows, written = facts.withColumn("_r", F.lit(1.0)), None
    for step in range(1, settings.steps + 1):
        gradient = _dot(residual) + pull * (F.col("_r") - 1)
        free = (F.col("_r") > 0) | (gradient < 0)
        share = F.when(free, t / float(tokens)).otherwise(0.0)
        second = [share * F.col("_p")[i] * F.col("_p")[j] for i in range(k) for j in range(i + 1)]
        got = sums(rows, second + [share * gradient * F.col("_p")[i] for i in range(k)])
        gram = np.zeros((k, k))
        gram[np.tril_indices(k)] = got[: len(second)]
        gram += np.tril(gram, -1).T
        # The inverse of pull + p p' over the free rows, applied to the gradient.
        held = np.linalg.solve(gram + pull * np.eye(k), got[len(second) :])
        direction = F.when(free, (gradient - _dot(held)) / pull).otherwise(0.0)
        tried = [F.greatest(F.lit(0.0), F.col("_r") - F.lit(a) * direction) for a in LENGTHS]
        named = rows.withColumns({f"_r{n}": c for n, c in enumerate(tried)})
        columns = [t * F.col(f"_r{n}") * F.col("_p")[i] for n in range(len(tried)) for i in range(k)]
        got = sums(named, columns + [t * F.pow(F.col(f"_r{n}") - 1, 2) for n in range(len(tried))]) / tokens
        residuals = got[: len(tried) * k].reshape(-1, k) - targets
        values = (residuals**2).sum(axis=1) + pull * got[len(tried) * k :]
        best = int(values.argmin()) if value is None or values.min() < value else None
        if best is None:
            break
        moved = np.abs(residuals[best] - residual).max()
        gained = np.inf if value is None else value - values[best]
        residual, value = residuals[best], values[best]
        rows = rows.withColumn("_r", tried[best])
        if step % WRITTEN == 0:
            rows = checkpointed(rows.select("_tokens", "_p", "_r"))
            if written is not None:
                released(written)
            written = rows
        if moved <= settings.tolerance and gained <= settings.tolerance**2:
            break
    return Fit(residual / pull, targets, residual, step)


def solve(facts: DataFrame, domains: list[str], settings: Settings) -> np.ndarray:
    """The vector m of the rates max(0, 1 - posterior . m)."""
    return fit(facts, domains, settings).m


def mixed(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), carry: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with tokens, posterior, rate and copies (columns of these names are replaced), and the domains.

    Texts are described once: the rows, or of each what ``carry`` names, are written with tokens and posteriors, and
    the rates are fitted on these.
    """
    spark = docs.sparkSession
    own = docs if carry is None else docs.select(*dict.fromkeys([*carry, "doc_id", "text"]))
    left_out = OUTPUT if carry is None else (*OUTPUT, *({"doc_id", "text"} - set(carry)))
    scored, domains = posteriors(common.wrapped(own, "doc_id", "text", without=left_out), labels, settings)
    path = scratch_path(spark, "mixing")
    scored.select("_user", "doc_id", "_tokens", "_p").write.parquet(path)
    described = spark.read.parquet(path)
    facts = described.select("_tokens", "_p")
    facts = checkpointed(common.compact(facts, facts.count(), 500_000))
    m = solve(facts, domains, settings)
    released(facts)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 11).cast("double") / float(1 << 53)
    whole = F.floor("_rate")
    found = described.withColumn("_rate", _rate(m))
    copies = (whole + (draw < F.col("_rate") - whole).cast("int")).cast("int")
    return found.select("_user.*", F.col("_tokens").alias("tokens"), F.col("_p").alias("posterior"), F.col("_rate").alias("rate"), copies.alias("copies")), domains
