"""Reusable relational operators over evidence tables."""
