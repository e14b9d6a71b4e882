"""llm of lexloom."""
