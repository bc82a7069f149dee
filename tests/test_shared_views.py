"""Queries that need the views more than once join them once."""
import pytest

from saddle.plans import catalog, queries_corpus, queries_geometry, tables
from saddle.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["mixed_schedule", "negative_samples_per_pair", "minkowski_distance_pairwise"])
def test_views_are_joined_once(spark, small, monkeypatch, name):
    asked, views = [], tables.views

    def once(*args):
        asked.append(args)
        return views(*args)

    for module in (tables, queries_corpus, queries_geometry):
        monkeypatch.setattr(module, "views", once, raising=False)
    assert catalog.QUERIES[name] is QUERIES[name]
    assert QUERIES[name](spark, small).columns and len(asked) == 1


def test_the_offset_reads_written_edges(spark, small):
    """Products move past the customers without a second join of orders and lines."""
    plan = tables.view_graph(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "Join" not in plan
