"""Structured Streaming jobs over interaction and run events."""
