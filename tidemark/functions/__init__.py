"""Column expressions: values and keys, geometry, vectors, text identity."""
