"""Column expressions and vocabularies."""
