"""Column functions: geometry, text, vectors. All are Catalyst expressions."""
