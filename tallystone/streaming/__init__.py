"""Structured Streaming over the sessions folder."""
