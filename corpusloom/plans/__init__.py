"""Derived views, composed plans and the registry of runnable queries."""


def all_queries():
    """Name to entry of every registered query, loading the modules that register them."""
    import importlib

    from corpusloom.plans.catalog import CATALOG

    for module in ("text_queries", "graph_queries", "retrieval_queries", "evaluation_queries", "conversation_queries", "storage_queries"):
        importlib.import_module(f"corpusloom.plans.{module}")
    return CATALOG
