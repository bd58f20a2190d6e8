"""Column functions: text, prices and counts, URLs, JSON, similarity, display."""
