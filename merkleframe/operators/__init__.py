"""Operators of the content-graph engine."""
