"""Structured Streaming forms of the page queries."""
