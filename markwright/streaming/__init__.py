"""Structured Streaming over answers."""
