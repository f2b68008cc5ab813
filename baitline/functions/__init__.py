"""Column-level building blocks and fixed value lists."""
