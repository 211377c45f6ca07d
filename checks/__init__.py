"""Queries over the benchmark tables and the SQL they are compared with."""


def all_queries():
    """``(queries, oracle)`` of every check module."""
    from checks import registry
    from checks import (cases, features, learning, ledgers, patterns, profiles, reports, risk,  # noqa: F401
                        rules, screening, streams, validation)
    return registry.QUERIES, registry.oracle()
