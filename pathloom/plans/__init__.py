"""Chained pipelines and the query catalogue."""
