"""Column functions of the graph engine."""
