"""Structured Streaming over the outbox."""
