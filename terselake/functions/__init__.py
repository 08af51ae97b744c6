"""Column functions: text, tokens, similarity, payloads."""
