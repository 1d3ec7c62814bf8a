"""Column functions, all in built-in expressions."""
