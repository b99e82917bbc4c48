"""Commodity-price analytics on Spark DataFrames.

Every function takes and returns DataFrames.  Series operators work on a whole
panel keyed by ``(commodity, state)``; a single pair is a filter in front.
"""
