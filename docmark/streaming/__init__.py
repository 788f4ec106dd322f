"""Structured Streaming forms of the status and intake operators."""
