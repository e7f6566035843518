"""Batches of a stream as segments of an index."""
