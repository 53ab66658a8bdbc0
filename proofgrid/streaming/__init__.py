"""Structured Streaming over result files."""
