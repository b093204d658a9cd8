"""Case records: normal form, checks, filters and the chat and export projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab import schemas
from corpuslab.functions import tags as tag_functions
from corpuslab.functions.text import blank_to_null
from corpuslab.operators import keys

# Fixed wording of the system prompt a case gets when it has none.
DEFAULT_SYSTEM_PROMPT = (
    "You write runnable Manim Community Edition Python files. "
    "Return only Python code, use `from manim import *`, and define exactly one scene class."
)
DEFAULT_LICENSE = "MIT"
LIST_COLUMNS = ("tags", "must_contain", "must_not_contain")


def _column(df: DataFrame, name: str) -> Column:
    """The column, or a null of its type where the table has none."""
    kind = next((f.dataType for f in schemas.CASE.fields if f.name == name), None)
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def first_message(messages: Column, role: str) -> Column:
    """Content of the first message of a role that has any content."""
    matching = F.filter(messages, lambda m: (m["role"] == role) & m["content"].isNotNull())
    return F.get(matching, F.lit(0))["content"]


def from_turns(turns: DataFrame, key: str, order: str, role: str = "role", content: str = "content") -> DataFrame:
    """Cases from a table of single turns: the first text of each role.

    The first text is a minimum, taken per task before the shuffle, so a conversation of any length
    is never gathered.
    """
    def first(name: str) -> Column:
        return F.min_by(content, F.when((F.col(role) == name) & F.col(content).isNotNull(), F.col(order)))

    return turns.groupBy(F.col(key).alias("case_id")).agg(
        first("system").alias("system"), first("user").alias("prompt"), first("assistant").alias("completion")
    )


def normalise(df: DataFrame) -> DataFrame:
    """Fill absent fields from the messages, defaults and empty lists; other columns pass through."""
    messages = _column(df, "messages")
    filled = {
        "system": F.coalesce(_column(df, "system"), first_message(messages, "system"), F.lit(DEFAULT_SYSTEM_PROMPT)),
        "prompt": F.coalesce(_column(df, "prompt"), first_message(messages, "user")),
        "completion": F.coalesce(_column(df, "completion"), first_message(messages, "assistant")),
    }
    for name in LIST_COLUMNS:
        filled[name] = tag_functions.or_empty(_column(df, name))
    return df.withColumns(filled)


def violations(df: DataFrame) -> DataFrame:
    """``(case_id, rule, severity, detail)`` for every normalised case that cannot be used; one pass."""
    missing = [
        F.when(
            F.col(name).isNull(),
            F.struct(F.lit("missing_key").alias("rule"), F.lit(name).alias("detail")),
        )
        for name in ("case_id", "prompt", "completion")
    ]
    blank = F.when(
        F.col("completion").isNotNull() & blank_to_null(F.col("completion")).isNull(),
        F.struct(F.lit("empty_completion").alias("rule"), F.lit("completion").alias("detail")),
    )
    found = F.explode(F.array_compact(F.array(*missing, blank))).alias("found")
    return df.select("case_id", found).select(
        "case_id", F.col("found.rule").alias("rule"), F.lit("error").alias("severity"), F.col("found.detail").alias("detail")
    )


def is_usable() -> Column:
    return F.coalesce(
        F.col("case_id").isNotNull() & F.col("prompt").isNotNull() & blank_to_null(F.col("completion")).isNotNull(), F.lit(False)
    )


def usable(df: DataFrame) -> DataFrame:
    """The normalised cases that ``violations`` does not list."""
    return df.filter(is_usable())


def tag_filter(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.filter(tag_functions.matches(F.col("tags"), include, exclude))


def prepare(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), strict: bool = True, label: str = "dataset", licensed: bool = False
) -> DataFrame:
    """Normalise all cases, filter by tags, and check that something is left and ids are unique.

    With ``licensed`` every row that is left must carry a licence. The checks are one pass; without ``strict`` nothing
    runs and unusable rows are left out.
    """
    normal = normalise(df)
    if strict:
        wanted = is_usable() & tag_functions.matches(F.col("tags"), include, exclude)
        faults = {"unusable": f"Unusable cases in {label}"} | ({"unlicensed": f"Missing row-level license metadata in {label}"} if licensed else {})
        unlicensed = [(wanted & lacks_license()).alias("unlicensed")] if licensed else []
        keys.gate(
            normal.select("case_id", wanted.alias("kept"), (~is_usable()).alias("unusable"), *unlicensed), "case_id", faults,
            repeated=f"Duplicate case_id values found in {label}",
            empty=f"No dataset cases matched filter for {label}.",
        )
    return tag_filter(usable(normal), include, exclude)


def _passthrough(df: DataFrame) -> list[Column]:
    return [_column(df, name).alias(name) for name in schemas.PASSTHROUGH_COLUMNS]


def _core(df: DataFrame) -> list[Column]:
    return [
        _column(df, name).alias(name)
        for name in ("case_id", "system", "prompt", "completion", "tags", "entry_scene", "must_contain", "must_not_contain")
    ]


def chat_messages() -> Column:
    turns = (("system", "system"), ("user", "prompt"), ("assistant", "completion"))
    return F.array(*[F.struct(F.lit(role).alias("role"), F.col(source).alias("content")) for role, source in turns])


def chat_records(df: DataFrame) -> DataFrame:
    """Fixed columns, the three messages, then the provenance columns (null where absent)."""
    return df.select(*_core(df), chat_messages().alias("messages"), *_passthrough(df))


def export_records(df: DataFrame) -> DataFrame:
    """The chat record without its messages."""
    return df.select(*_core(df), *_passthrough(df))


def lacks_license() -> Column:
    return blank_to_null(F.col("license")).isNull()


def license_gaps(df: DataFrame) -> DataFrame:
    """Ids of cases with no row-level licence."""
    return df.filter(lacks_license()).select(
        F.coalesce(F.col("case_id"), F.lit("<missing-case-id>")).alias("case_id")
    )


def license_gap_preview(df: DataFrame, size: int = 10) -> DataFrame:
    """The first ids in order, the shape an error message shows (a top-k plan, never a full sort)."""
    return license_gaps(df).orderBy("case_id").limit(size)


def with_default_license(df: DataFrame, default: str = DEFAULT_LICENSE) -> DataFrame:
    return df.withColumn("license", F.coalesce(blank_to_null(F.col("license")), F.lit(default)))
