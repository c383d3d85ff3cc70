"""Column expressions, and NumPy helpers that see one crop or one outline at a time."""
