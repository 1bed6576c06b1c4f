"""Column helpers and table helpers."""
