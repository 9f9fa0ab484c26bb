"""All registered queries."""

from plumbline.plans import (  # noqa: F401
    queries_companies,
    queries_corpus,
    queries_events,
    queries_fundamentals,
    queries_valuation,
)
from plumbline.plans.registry import CHECKS, COVERS, QUERIES  # noqa: F401
