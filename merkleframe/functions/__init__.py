"""Functions of the content-graph engine."""
