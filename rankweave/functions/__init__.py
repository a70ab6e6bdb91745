"""Column expressions: vectors, text, weights."""
