"""All queries, in the order they are listed."""

from checks import (  # noqa: F401
    case_queries,
    code_queries,
    corpus_queries,
    evaluation_queries,
    experiment_queries,
    review_queries,
    source_queries,
    stream_queries,
)
from checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
