"""Structured Streaming forms of the ordered and windowed operators."""
