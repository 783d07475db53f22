"""Structured Streaming maintenance paths."""
