"""Expressions and aggregates that are not tied to one table."""
