"""Structured Streaming operators (buffer, filter, aggregate, transform, UDFs)."""
