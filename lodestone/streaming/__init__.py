"""Structured Streaming: keeping an index current."""
