"""Structured Streaming jobs over the log operators."""
