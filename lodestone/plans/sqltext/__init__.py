"""SQL as text: parse, format, transpile, lint and trace it without touching data."""
