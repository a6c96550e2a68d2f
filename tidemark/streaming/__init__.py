"""Structured Streaming form of the online response."""
