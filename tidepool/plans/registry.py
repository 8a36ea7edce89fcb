"""All registered queries of the library and their SQL counterparts."""

from tidepool.plans import (  # noqa: F401
    graph_queries,
    lifecycle_queries,
    quality_queries,
    relational_queries,
    retrieval_queries,
    state_queries,
    tenant_queries,
    text_queries,
)
from tidepool.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
