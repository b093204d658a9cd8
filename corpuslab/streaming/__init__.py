"""Structured Streaming jobs over append-only logs. Each gives what its batch twin gives."""
