"""Column helpers: URLs, text, sets, query terms."""
