"""Structured Streaming: reviews as they arrive."""
