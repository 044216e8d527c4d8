"""Column expressions: text, sets, vectors and metrics."""
