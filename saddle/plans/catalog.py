"""All registered queries."""
from saddle.plans import (  # noqa: F401
    queries_analytics,
    queries_classifiers,
    queries_cleaning,
    queries_corpus,
    queries_geometry,
    queries_graph,
    queries_sources,
    queries_streaming,
    queries_training,
)
from saddle.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
