"""Sources of the content-graph engine."""
