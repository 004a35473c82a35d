"""Streaming of the content-graph engine."""
