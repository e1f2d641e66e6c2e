"""Column functions: text, vectors and hashing."""
