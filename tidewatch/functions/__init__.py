"""Column expressions: text, vectors, geography and time."""
