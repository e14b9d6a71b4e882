"""operators of lexloom."""
