"""Column expressions: scalar mathematics and distribution families."""
