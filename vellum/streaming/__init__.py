"""Structured Streaming forms of log operators."""
