"""Operators for preparing training text: dedup, filters, language, packing, sharding, search.

One module per operator; ``queries.py`` registers them over the test tables.
Nothing outside this subpackage imports it.
"""
