"""Readers and writers for price records, series and forecasts."""
