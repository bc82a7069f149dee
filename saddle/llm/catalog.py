"""All queries of this subpackage."""
from saddle.llm import queries_native, queries_records, queries_search, queries_text  # noqa: F401
from saddle.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
