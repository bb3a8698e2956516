"""Operators of a training-data pipeline, one module each, and their queries."""


def load_queries():
    """Import the query module and return ``(queries, oracles)``."""
    from . import queries

    return queries.QUERIES, queries.ORACLES
