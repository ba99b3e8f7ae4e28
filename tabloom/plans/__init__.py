"""Registered queries: each runs an operator on the given tables and states the same result in SQL."""
