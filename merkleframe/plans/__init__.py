"""Plans of the content-graph engine."""
