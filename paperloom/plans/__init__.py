"""Corpora derived from the base tables, and the queries over them."""


def load_queries():
    """Import all query modules and return ``(queries, oracles)``."""
    from . import office_queries, registry, report_queries, stream_queries, text_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
