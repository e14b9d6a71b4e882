"""functions of lexloom."""
