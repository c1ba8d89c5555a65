"""Structured Streaming re-aims of the decision log and its statistics."""
