"""Structured Streaming wrappers of the batch plans."""
