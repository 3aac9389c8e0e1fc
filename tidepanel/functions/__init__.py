"""Column functions: parsing, names, guarded arithmetic and statistics."""
