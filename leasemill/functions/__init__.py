"""Column expressions and the vocabulary they use."""
