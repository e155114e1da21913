"""Structured Streaming on versioned tables."""
