"""Catalogue queries, series operators, statistics, evaluation, drift, advisory."""
