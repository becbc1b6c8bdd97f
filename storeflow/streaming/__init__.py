"""Structured Streaming over point-of-sale events."""
