"""sources of lexloom."""
