"""Operators put together, and the queries that check them on the given tables."""
