"""Queries over the bound tables, each with its SQL check."""

from importlib import import_module

MODULES = ["graph_queries", "source_queries", "column_queries", "build_queries", "vector_queries"]


def all_queries():
    """The registry with every query module loaded."""
    for name in MODULES:
        import_module(f"shelfgraph.plans.{name}")
    return import_module("shelfgraph.plans.registry")
