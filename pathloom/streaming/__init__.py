"""Structured Streaming forms of the stateless and last-point operators."""
