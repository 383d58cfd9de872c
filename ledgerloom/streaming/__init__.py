"""Structured Streaming jobs over the append-only decision and usage logs."""
