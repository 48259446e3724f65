"""A module of queries that cannot be imported is an error, not a shorter list of queries."""

import pytest


def test_broken_module_is_loud(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "MODULES", ["tessera.plans.no_such_module"])
    with pytest.raises(ImportError):
        __spark_entry__.queries()


def test_llm_queries_come_with_their_subpackage():
    import importlib.util

    import __spark_entry__

    there = importlib.util.find_spec("tessera.llm") is not None
    assert ("p1_found" in __spark_entry__.queries()) == there and "leaderboard" in __spark_entry__.queries()
