"""All registered queries."""

from gonggo.plans import (  # noqa: F401
    ingest_queries, match_queries, model_queries, page_queries, pool_queries, tech_queries,
    text_queries, trend_queries, urgency_queries)
from gonggo.plans.registry import CHECKS, QUERIES  # noqa: F401
