"""Queries over the given tables, each with an equivalent SQL text."""
