"""Structured Streaming twins of operators."""
