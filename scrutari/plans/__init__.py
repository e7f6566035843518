"""Queries as trees, and what they compile to."""
