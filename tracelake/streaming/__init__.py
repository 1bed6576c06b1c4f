"""Structured Streaming forms of the per-session operators."""
