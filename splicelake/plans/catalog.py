"""All registered queries."""

from splicelake.plans import (  # noqa: F401
    queries_domains,
    queries_exons,
    queries_ids,
    queries_search,
    queries_similarity,
    queries_sources,
    queries_stats,
    queries_store,
)
from splicelake.plans.registry import ORACLE, QUERIES  # noqa: F401
