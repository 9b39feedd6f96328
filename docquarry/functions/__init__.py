"""Column expressions and ordered-data helpers."""
