"""Tag lists: filters, ordered merges and the tags a case earns on the way through curation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the duration classes in seconds, and the class beyond the last (fixed values).
DURATION_CLASSES = ((6, "duration:5s"), (12, "duration:10s"), (22, "duration:20s"), (40, "duration:30s"))
LONGEST_DURATION = "duration:50s"

# Tags of a case that waits for review, and those it gets once approved (fixed values).
STAGING_TAGS = ("review-candidate", "tier:candidate", "status:unreviewed")
APPROVED_TIER = "tier:silver"
APPROVED_TAGS = ("status:approved", "source:review-promotion")


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def or_empty(tags: Column) -> Column:
    return F.coalesce(tags, F.array().cast("array<string>"))


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def matches(tags: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """All of ``include`` and none of ``exclude``; an empty list switches that side off."""
    verdict = F.lit(True)
    for tag in include:
        verdict = verdict & has_tag(tags, tag)
    for tag in exclude:
        verdict = verdict & ~has_tag(tags, tag)
    return verdict


def append_missing(tags: Column, extra: Column) -> Column:
    """``tags`` as they are, then each of ``extra`` that is new: order and repeats of ``tags`` stay.

    ``extra`` itself is walked left to right, so a tag listed twice there is added once.
    """
    return F.concat(
        or_empty(tags),
        F.filter(F.array_distinct(or_empty(extra)), lambda t: ~F.coalesce(F.array_contains(or_empty(tags), t), F.lit(False))),
    )


def duration_tag(seconds: Column) -> Column:
    tag = F.when(seconds.isNull(), F.lit(None).cast("string"))
    for bound, name in DURATION_CLASSES:
        tag = tag.when(seconds <= bound, name)
    return tag.otherwise(LONGEST_DURATION)


def with_provenance(tags: Column, source_tags: Column, seconds: Column) -> Column:
    """Source tags and the duration class merged into ``tags``."""
    return append_missing(tags, F.concat(or_empty(source_tags), F.array_compact(F.array(duration_tag(seconds)))))


def promoted(tags: Column, tier: str = APPROVED_TIER) -> Column:
    """Staging tags out, tier and approval tags in."""
    kept = F.filter(or_empty(tags), lambda t: ~F.coalesce(t.isin(*STAGING_TAGS), F.lit(False)))
    return append_missing(kept, string_array((tier, *APPROVED_TAGS)))
