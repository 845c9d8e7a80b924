"""Structured Streaming forms of the flow operators."""
