"""Structured Streaming forms of the window features and of scoring."""
