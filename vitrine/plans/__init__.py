"""Registered queries, each beside the SQL that checks it."""

from vitrine.plans import (  # noqa: F401
    analytics_queries,
    clean_queries,
    feature_queries,
    ranking_queries,
    retrieval_queries,
    search_queries,
    source_queries,
    training_queries,
)
from vitrine.plans.registry import ORACLES, QUERIES  # noqa: F401
