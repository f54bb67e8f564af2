"""Structured Streaming jobs; every one has a batch twin in `operators`."""
