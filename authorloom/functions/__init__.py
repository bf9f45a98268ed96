"""Column expressions: text, hashing, URLs, phrases."""
