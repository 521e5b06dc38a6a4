"""Column builders: pure expressions without side effects."""
