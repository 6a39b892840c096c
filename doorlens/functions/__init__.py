"""Column expressions: geometry, text, hashing and numeric helpers."""
