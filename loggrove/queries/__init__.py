"""The checked queries: each one runs an operator over whole input tables, most of
them next to an equivalent SQL text."""

from loggrove.queries.registry import all_queries, all_sql  # noqa: F401
